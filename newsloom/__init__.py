"""Spark jobs that turn loosely structured items into scored business events."""
