"""A Spark-native engine for building and validating retrieval evaluation sets."""
