"""Structured Streaming forms of the operators that work row by row."""
