"""Structured Streaming front end for scoring."""
