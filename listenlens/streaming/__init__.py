"""Structured Streaming jobs (K1 interaction windows, K2 track import)."""
