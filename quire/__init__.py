"""Corpus analytics on Spark: structure, query, align, check and follow the reading of document collections."""

__version__ = "0.1.0"
