"""Incremental ingest and incremental results with Structured Streaming."""
