"""Spark-native evidence and retrieval analytics."""
