"""Column expressions: scalar and array formulas without any plan of their own."""
