"""Structured Streaming forms of the import and of the daily trend."""
