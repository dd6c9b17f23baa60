"""Scans, ingest steps and sinks."""
