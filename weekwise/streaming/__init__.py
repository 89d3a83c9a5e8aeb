"""Incremental runs of the weekly aggregates with Structured Streaming."""
