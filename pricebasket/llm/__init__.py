"""Training-data operators: tokenising, language ID, deduplication, search, mixing, sharding and storage."""
