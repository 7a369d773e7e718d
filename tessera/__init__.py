"""Spark-native quality analytics for source files and text tables."""
