"""Column expressions: text, rules, languages and row hashes."""
