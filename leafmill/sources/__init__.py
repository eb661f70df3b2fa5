"""Sources of the book-text engine."""
