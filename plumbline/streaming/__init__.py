"""Incremental scans with Structured Streaming."""
