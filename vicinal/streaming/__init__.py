"""Structured Streaming: incremental insert and metrics."""
