"""Column expressions: name keys, identifiers, tolerant casts, set fingerprints and vectors."""
