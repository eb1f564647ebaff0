"""Training-data operators: deduplication, tokens, packing, scoring and scans over Spark tables."""
