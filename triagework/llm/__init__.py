"""Operators for large training-data sets: scoring, filtering, deduplication, packing, sharding and encoding of text."""
