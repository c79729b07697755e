"""Operators for large collections of training text, and their queries."""
