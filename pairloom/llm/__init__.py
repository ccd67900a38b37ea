"""Operators for training-data pipelines: sharding, mixing, search, filters, deduplication, counts."""
