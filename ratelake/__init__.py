"""A PySpark-native engine for rating data."""
