"""Spark-native analytics engine for scholarly-document collections."""
