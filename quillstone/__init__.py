"""Spark-native retrieval analytics over labelled text corpora."""
