"""Spark-native analytics for document screening: text functions, operators, stores and plans."""

__version__ = "0.1.0"
