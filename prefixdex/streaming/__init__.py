"""Structured Streaming jobs over search events."""
