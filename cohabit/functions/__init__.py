"""Column functions beyond the built-in ones."""
