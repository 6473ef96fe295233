"""Column expressions: fingerprints, tags, typed values and merges."""
