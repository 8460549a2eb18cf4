"""Operators for training-data pipelines over a documents table.

Nothing outside this package imports it.  ``queries.py`` holds the registered queries,
every other module one operator with its own general interface.
"""
