"""Operators for preparing training text: deduplication, filters, fingerprints, tokens, packing."""
