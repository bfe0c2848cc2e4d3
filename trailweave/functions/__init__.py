"""Column expressions and kernel tables."""
