"""Column expressions and distributed ranking helpers shared by all operators."""
