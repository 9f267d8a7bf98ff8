"""Incremental fitting over Structured Streaming."""
