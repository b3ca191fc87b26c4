"""Structured Streaming forms of the daily update."""
