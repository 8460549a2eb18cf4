"""Readers and writers of tables and annotated matrices."""
