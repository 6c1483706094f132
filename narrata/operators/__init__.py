"""Relational operators: links between rows, splits, samples."""
