"""A Spark-native engine for reviewable table workflows."""
