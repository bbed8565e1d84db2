"""Operators on point tables and message tables."""
