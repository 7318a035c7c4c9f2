"""Structured Streaming forms of the loading jobs."""
