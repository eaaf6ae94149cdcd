"""Operators on conversations."""
