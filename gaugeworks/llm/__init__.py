"""Operators for preparing training data: dedup, sharding, tokens, extraction, filtering, packing."""
