"""Structured Streaming variants of ingest and of the trace-log statistics."""
