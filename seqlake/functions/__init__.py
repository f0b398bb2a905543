"""Column functions: text, numbers, codes, hashes."""
