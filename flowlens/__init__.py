"""Spark-native analytics for directed money-transfer networks."""
