"""Training-data operators: deduplication, sharding, packing, scoring, encoding, search, fingerprints."""
