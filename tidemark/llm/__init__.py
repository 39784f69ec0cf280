"""Training-data operators (deduplication, sharding, scoring, packing, mixing, search) on Spark."""
