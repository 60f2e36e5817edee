"""Spark-native statistics for gridded, graph-structured and time-series data."""
