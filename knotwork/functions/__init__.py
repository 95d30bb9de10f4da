"""Column expressions: numeric rules, geography, sets, time, statistics."""
