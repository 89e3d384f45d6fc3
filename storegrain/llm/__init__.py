"""Operators for training data: deduplication, tokens, quality, fingerprints, decontamination, filters, shards."""
