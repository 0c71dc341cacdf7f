"""Operators that prepare text and code for training. Nothing outside this package imports it."""
