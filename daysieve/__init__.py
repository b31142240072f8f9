"""Spark-native analytics over activity evidence."""
