"""Structured Streaming jobs built on the same operators as the batch jobs."""
