"""Spark-native quality engine for versions of periodic fact tables."""
