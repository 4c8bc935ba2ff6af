"""Training-data operators: scoring, filtering, deduplication, packing, sharding, personal data."""
