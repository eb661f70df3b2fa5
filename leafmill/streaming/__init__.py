"""Streaming of the book-text engine."""
