"""Functions of the book-text engine."""
