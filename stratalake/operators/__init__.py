"""Operators on catalogs of row groups."""
