"""Spark-native analytics for float, profile and depth-measurement tables."""
