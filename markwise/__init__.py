"""Spark-native analytics for multiple-choice evaluation data."""
