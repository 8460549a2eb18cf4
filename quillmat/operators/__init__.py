"""Operators on tables and annotated matrices."""
