"""Column functions: text, vectors, arrays, hashing, fuzzy matching."""
