"""A PySpark-native document retrieval and analytics engine."""
