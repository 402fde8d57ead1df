"""Spark-native preparation and analysis of text-training corpora."""
