"""Readers: driver tables, nested examples, passages, queries, synthetic data, results CSV."""
