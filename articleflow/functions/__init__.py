"""Column expressions: text clean-up, tokens, summaries, numbers."""
