"""Column expressions: dates, scalars and the feature list."""
