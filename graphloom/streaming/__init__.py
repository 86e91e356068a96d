"""Structured Streaming forms of the log fold and the metrics."""
