"""Column functions: each takes columns (or names) and returns a column."""
