"""Weftmark: corpus analytics for marked-up text, expressed as Spark DataFrames."""

__version__ = "0.1.0"
