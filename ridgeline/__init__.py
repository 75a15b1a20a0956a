"""A Spark-native engine for keyed change data with optional vectors."""
