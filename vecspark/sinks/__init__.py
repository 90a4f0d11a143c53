"""Vector-table writes: overwrite, upsert (merge-on-read versions), dimension check."""
