"""Spark-native analytics over public-procurement data."""

__version__ = "0.1.0"
