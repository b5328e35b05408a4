"""Spark-native analytics over point-in-time decision data."""
