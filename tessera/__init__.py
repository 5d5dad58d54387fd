"""A PySpark-native retrieval-analytics engine."""
