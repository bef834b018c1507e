"""Stratavox: analytics on very large sets of measured 3-D points, expressed as Spark DataFrame plans."""

__version__ = "0.2.0"
