"""Catalogue of entries and written intermediate tables."""
