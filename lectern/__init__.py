"""Spark-native preparation of large text collections for speech and analytics."""
