"""Column-expression builders shared by operators and oracles."""
