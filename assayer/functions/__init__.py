"""Column functions: text normalisation, tokens, numbers, identifiers and hashes."""
