"""Structured Streaming forms of deduplication, counters and incremental indexing."""
