"""Column expressions over terms."""
