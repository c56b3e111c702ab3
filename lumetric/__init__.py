"""Spark-native analytics for item response theory and adaptive testing."""

__version__ = "0.1.0"
