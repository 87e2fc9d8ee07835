"""Column builders and exact order statistics."""
