"""Incremental ingest, deduplication and linkage."""
