"""Plans of the book-text engine."""
