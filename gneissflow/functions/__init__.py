"""Column functions: paths, text, hashes."""
