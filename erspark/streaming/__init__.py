"""Incremental matching with Structured Streaming."""
