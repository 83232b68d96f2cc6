"""Column expressions: patterns, severity rules, tokens, vectors."""
