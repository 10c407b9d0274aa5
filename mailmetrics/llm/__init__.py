"""Operators for training-data pipelines (text, pages, vectors).

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface; ``queries.py`` holds the thin queries that
apply them to the driver's tables.
"""
