"""Structured Streaming forms of the event operators."""
