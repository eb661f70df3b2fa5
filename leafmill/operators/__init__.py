"""Operators of the book-text engine."""
