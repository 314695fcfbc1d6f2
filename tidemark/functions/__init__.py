"""Column expressions and ordered (window) functions."""
