"""Spark-native analytics for read, count-matrix and transcript tables."""
