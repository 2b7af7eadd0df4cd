"""Operators for preparing training text on Spark; nothing outside this folder imports it."""
