"""Spark-native retrieval analytics: chunk, index, retrieve, examine and tune as DataFrame plans."""
