"""Column functions: pure expressions without a shuffle."""
