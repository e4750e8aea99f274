"""A Spark-native engine for validating, inferring over and repairing graphs."""
