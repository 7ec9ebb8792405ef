"""Operators on training texts; nothing outside this subpackage imports it."""
