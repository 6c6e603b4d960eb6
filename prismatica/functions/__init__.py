"""Column expressions, column discovery and the shared aggregate helpers."""
