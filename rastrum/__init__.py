"""Dataset curation and training-data analytics as plain Spark DataFrame operations."""

__version__ = "0.1.0"
