"""Column functions and values."""
