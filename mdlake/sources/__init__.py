"""Readers of document collections."""
