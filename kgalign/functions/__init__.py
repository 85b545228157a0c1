"""Column expressions on strings and arrays."""
