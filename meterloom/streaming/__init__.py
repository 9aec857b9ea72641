"""Structured Streaming front of the store."""
