"""Operators for large training-text collections (see ``queries.py`` for the registered ones)."""
