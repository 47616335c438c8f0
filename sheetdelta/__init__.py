"""Revision comparison of large document collections as Spark table jobs."""

__version__ = "0.1.0"
