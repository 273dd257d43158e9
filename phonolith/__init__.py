"""Phonolith: Spark-native catalog, search and signal operators for media libraries."""

__version__ = "0.1.0"
