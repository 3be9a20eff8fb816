"""Column expressions: projection arithmetic, performance curves, gates, labels."""
