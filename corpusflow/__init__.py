"""A PySpark-native engine for text retrieval and analytics."""
