"""Whole pipelines composed from the operators, and the query catalogue."""
