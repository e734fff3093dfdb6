"""Column functions over records."""
