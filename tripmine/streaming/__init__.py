"""Structured Streaming forms of the gate and of ingest."""
