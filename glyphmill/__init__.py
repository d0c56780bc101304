"""A PySpark-native engine for building and analysing diagram datasets."""
