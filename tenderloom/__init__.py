"""Spark-native analytics for public-procurement style records."""
