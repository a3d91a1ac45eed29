"""Structured Streaming front-ends."""
