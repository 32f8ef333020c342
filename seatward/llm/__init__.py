"""Operators for large-scale training data: deduplication, mixing, packing, filtering, sharding and archives."""
