"""Column functions: text, citation keys, vectors, statistics."""
