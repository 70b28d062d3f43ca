"""Operators for training-data pipelines: search, scoring, filtering, deduplication, archives, mixing and packing."""
