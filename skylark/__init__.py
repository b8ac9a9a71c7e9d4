"""A PySpark-native engine for full-text search, merchandising and search analytics."""
