"""Spark-native analytics over text knowledge bases and the graphs inside them."""
