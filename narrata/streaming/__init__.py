"""Structured Streaming around the row-local operators."""
