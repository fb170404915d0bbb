"""Column expressions and ordered statistics shared by the operators."""
