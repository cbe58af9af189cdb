"""Column expressions: every function maps columns to columns with Spark built-ins only."""
