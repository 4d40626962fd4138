"""Column expressions: instants, JSON, thresholds, freshness, text."""
