"""Structured Streaming versions of the batch pipelines."""
