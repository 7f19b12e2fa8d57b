"""Spark-native analytics for large collections of activity recordings."""
