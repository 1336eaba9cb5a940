"""Trawl: a Spark-native file-catalog search engine."""
