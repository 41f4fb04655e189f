"""Structured Streaming operators: ingest, dedup, counters, feature upkeep,
the per-user event buffer and prediction feedback."""
