"""Retrieval, ranking and corpus analytics as declarative Spark plans."""

__version__ = "0.1.0"
