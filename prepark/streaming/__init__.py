"""Structured Streaming twins of the request-time operators."""
