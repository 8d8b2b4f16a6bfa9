"""Column builders for tokens and values."""
