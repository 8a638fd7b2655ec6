"""Readers and writers: price panels, news payloads, article files, fitted models."""
