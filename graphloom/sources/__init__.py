"""Graphs from tables."""
