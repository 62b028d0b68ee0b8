"""Spark-native operators for event-program data and large text corpora."""
