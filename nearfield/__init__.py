"""Spark-native vector search and nearest-neighbour analytics."""
