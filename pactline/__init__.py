"""Deal-news analytics as plain PySpark DataFrame jobs."""

__all__ = ["session"]
