"""Column expressions: text folding and tokens, relevance scoring, Bloom sizing."""
