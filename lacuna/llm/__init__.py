"""Operators for large text corpora, each with a checkable query. Nothing else in the library imports this package."""
