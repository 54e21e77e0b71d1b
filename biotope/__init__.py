"""Spark-native analytics for occurrence tables, gridded layers and training-data corpora."""
