"""Operators that prepare text and vectors for training. Nothing outside imports this package."""
