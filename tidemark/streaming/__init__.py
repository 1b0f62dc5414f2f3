"""Incremental views as Structured Streaming queries."""
