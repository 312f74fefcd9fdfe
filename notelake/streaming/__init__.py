"""Structured Streaming forms of maintenance."""
