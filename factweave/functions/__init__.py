"""Column functions: text, numbers, bytes."""
