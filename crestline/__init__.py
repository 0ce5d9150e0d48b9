"""Spark-native analytics of extreme events in ordered data."""
