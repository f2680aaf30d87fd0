"""Spark-native analytics over long conversations and their compacted contexts."""
