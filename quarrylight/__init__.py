"""Spark-native analytics over text and source-code corpora."""
