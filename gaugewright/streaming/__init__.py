"""Incremental state by Structured Streaming."""
