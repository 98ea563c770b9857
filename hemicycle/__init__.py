"""Spark-native analytics over civic voting data."""

__version__ = "0.1.0"
