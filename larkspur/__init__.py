"""A Spark-native engine for data-engineering workloads."""
