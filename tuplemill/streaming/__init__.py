"""Structured Streaming readers."""
