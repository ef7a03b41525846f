"""Spark-native analytics for large collections of dated documents."""
