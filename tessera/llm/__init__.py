"""Training-data operators: fingerprints, search, counting, scans, sharding, mixing, dedup, quality, BPE."""
