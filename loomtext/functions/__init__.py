"""Column expressions: text normalisation, hashing, scalar helpers."""
