"""Column expressions: text, similarity and box geometry."""
