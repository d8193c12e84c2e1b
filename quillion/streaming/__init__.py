"""Structured Streaming extras."""
