"""Incremental ingestion as a stream."""
