"""A PySpark-native analytics engine for document collections."""
