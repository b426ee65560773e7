"""A PySpark-native analytics engine for code-intelligence tables and training-data corpora."""
