"""A PySpark-native engine for change history, and operators for training data."""
