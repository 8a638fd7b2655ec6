"""Column expressions and the Arrow functions that have no built-in equivalent."""
