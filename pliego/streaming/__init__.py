"""Incremental builds with Structured Streaming."""
