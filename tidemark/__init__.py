"""tidemark: a PySpark-native engine that explains a set of tables."""
