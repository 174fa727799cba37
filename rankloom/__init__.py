"""Spark-native evaluation and retrieval analytics."""
