"""Continuous ingest of message files."""
