"""Spark operators for artifact catalogs: filter, page, classify, join, group, sequence and export."""

__version__ = "0.1.0"
