"""Structured Streaming: keyed state, deduplication and upserts as data arrive."""
