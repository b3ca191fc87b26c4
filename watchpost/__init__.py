"""Spark-native analytics over public-health signals."""
