"""Column expressions; every function takes columns or column names and returns a column."""
