"""Readers of landed payloads and pages, and sinks."""
