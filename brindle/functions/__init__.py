"""Column expressions: keys, bounds, model arithmetic."""
