"""Spark-native product search analytics: retrieval, ranking, entity resolution and evaluation as DataFrame plans."""
