"""Column expressions: features, quantisation, distances."""
