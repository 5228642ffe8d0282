"""Structured Streaming forms of ingestion and of windowed reports."""
