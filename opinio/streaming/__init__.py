"""Structured Streaming forms of ingest, daily ratings and upsert."""
