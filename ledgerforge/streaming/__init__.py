"""Ingestion as a file stream."""
