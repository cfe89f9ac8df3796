"""Training-data operators: packing, formatting, dedup, filters, mixing, fingerprints, token files."""
