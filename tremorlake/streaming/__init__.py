"""Structured Streaming ingest. Parse and enrich are plain operators that also run on batches."""
