"""Column expressions: numbers, score models, grade bands and texts."""
