"""Operators for large training-data pipelines.

Nothing outside this package imports it: ``mdlake`` works without it, and
``__spark_entry__`` adds its queries only where the package is present.
"""
