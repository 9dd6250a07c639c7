"""Training-data operators: filtering, deduplication, counting, mixing, sharding, search and archives."""
