"""Composed queries and their registry."""
