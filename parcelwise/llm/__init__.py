"""Operators for preparing training data: deduplication, mixing, filtering, archives and tokens."""
