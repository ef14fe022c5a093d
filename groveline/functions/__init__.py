"""Column expressions: growth curves, liveness, scores."""
