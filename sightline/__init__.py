"""Spark-native evidence analytics over recorded network observations."""
