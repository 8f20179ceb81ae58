"""Column expressions: text rules, lexicon matching, scores."""
