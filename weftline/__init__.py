"""Weftline: a Spark-native engine for parallel-corpus quality work."""

__version__ = "0.1.0"
