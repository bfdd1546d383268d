"""Column-level functions: every one returns a Catalyst expression, none runs Python per row."""
