"""Transaction-risk analytics as plain PySpark DataFrame operations."""

__version__ = "0.1.0"
