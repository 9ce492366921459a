"""Structured Streaming forms of the measurement operators."""
