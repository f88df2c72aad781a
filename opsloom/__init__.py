"""Spark-native analytics over database-operations data and large text corpora."""
