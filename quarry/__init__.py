"""Quarry: a PySpark-native retrieval analytics engine."""
