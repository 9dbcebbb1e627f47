"""Column functions: text normalisation, tokens, fuzzy ratios."""
