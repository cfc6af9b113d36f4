"""Column expressions: timestamps, JSON fields, keys, and window texts."""
