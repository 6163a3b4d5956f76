"""Training-data operators: license scans, deduplication, tokenising, sharding, search, mixing, language ID."""
