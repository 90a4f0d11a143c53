"""Structured Streaming: incremental vector ingest and streamed search."""
