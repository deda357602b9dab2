"""Spark-native analytics over text corpora and the entity graphs extracted from them."""
