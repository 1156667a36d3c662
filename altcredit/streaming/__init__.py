"""Loading feed files as they arrive."""
