"""Structured Streaming forms of the event logic, each with a batch twin."""
