"""Structured Streaming jobs: ingest and change signals."""
