"""Operators for preparing language-model training data.

Nothing else in the library imports this package; its queries are registered
by ``__spark_entry__`` when the package is present.
"""
