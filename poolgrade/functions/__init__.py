"""Column expressions: scalar arithmetic, text normalisation and label rules."""
