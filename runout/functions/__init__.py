"""Column expressions and calendar lookups shared by the operators."""
