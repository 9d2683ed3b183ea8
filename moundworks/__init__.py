"""Spark-native analytics over event-level tracking data."""
