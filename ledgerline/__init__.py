"""Spark-native evidence and catalogue analytics."""
