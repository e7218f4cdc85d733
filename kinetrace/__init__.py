"""Spark-native analytics for dense, vector-valued time series."""
