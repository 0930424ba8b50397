"""Operators for training-data pipelines: scoring, filtering, deduplication, packing."""
