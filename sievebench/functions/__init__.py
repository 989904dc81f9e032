"""Column expressions and small closed forms."""
