"""Composed views over the driver tables and the report tables built on them."""
