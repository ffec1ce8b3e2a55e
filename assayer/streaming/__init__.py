"""Structured Streaming forms of ingestion, ledgers and request caches."""
