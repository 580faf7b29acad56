"""Continuous ingest and the live tail, as Structured Streaming queries."""
