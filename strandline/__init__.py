"""Spark-native analytics over streams of signed social events."""
