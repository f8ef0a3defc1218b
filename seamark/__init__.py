"""Seamark: knowledge-corpus preparation, composition and retrieval as Spark jobs."""

__version__ = "0.1.0"
