"""Column expressions: pattern matching with spans, languages, tokens."""
