"""Column expressions, packed flags and join helpers shared by the operators."""
