"""Training-data operators: sharding, fingerprints, token files, secrets, chat, near-duplicates, quality, packing, tokens."""
