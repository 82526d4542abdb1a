"""Lodestone: content identity, encoding, reuse and comparison as Spark DataFrames."""

__version__ = "0.1.0"
