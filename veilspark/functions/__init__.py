"""Column expressions: digests, checksums, normal forms, layouts. No Python runs per row."""
