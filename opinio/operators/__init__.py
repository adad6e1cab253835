"""Relational operators over review tables."""
