"""graphloom.cypher"""
