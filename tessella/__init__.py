"""Spark-native analytics for item-level response data."""
