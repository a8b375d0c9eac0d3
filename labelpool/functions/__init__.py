"""Column builders: vectors and distances, uncertainty scores, text, hashing."""
