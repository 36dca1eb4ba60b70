"""Column expressions: text, keys, distances, comparison levels."""
