"""Structured Streaming front end (an extension: batch is complete without it)."""
