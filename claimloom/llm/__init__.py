"""Operators for preparing training data, and the queries that apply them to whole tables.

Nothing else in the library imports this package.
"""
