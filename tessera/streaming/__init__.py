"""Structured Streaming forms of the monotone steps."""
