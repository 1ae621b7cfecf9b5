"""Queries over the given tables; see ``catalog`` for the full list."""
