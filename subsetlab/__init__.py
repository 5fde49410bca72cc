"""Spark-native analytics for ordered series of k-of-N subset events."""
