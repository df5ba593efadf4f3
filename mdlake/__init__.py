"""mdlake: a PySpark engine for document corpora."""
