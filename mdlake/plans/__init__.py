"""Declared configuration, compiled to columns and joins on the driver."""
