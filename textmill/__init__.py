"""textmill: a PySpark-native engine for preparing large text corpora."""
