"""Column expressions: paths, text, hashes and pattern matches with line numbers."""
