"""Structured Streaming forms of the state and change operators."""
