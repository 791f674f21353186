"""A PySpark-native engine for building, checking, mixing and evaluating retrieval data."""
