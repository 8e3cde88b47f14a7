"""Column builders: no Python runs per row."""
