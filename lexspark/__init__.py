"""lexspark: Spark-first processing and retrieval for versioned document corpora."""

__version__ = "0.1.0"
