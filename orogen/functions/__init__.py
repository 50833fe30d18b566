"""Column expressions of the terrain operators."""
