"""Structured Streaming forms of the timed operators; each has a batch twin."""
