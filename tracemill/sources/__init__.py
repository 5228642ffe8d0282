"""Ingestion jobs: exported files in, canonical events out."""
