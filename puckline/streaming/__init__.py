"""Incremental ingestion of landed documents with Structured Streaming."""
