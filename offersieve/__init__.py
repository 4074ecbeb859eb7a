"""PySpark-native offer relevance engine."""
