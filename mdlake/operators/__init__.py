"""Operators over document tables."""
