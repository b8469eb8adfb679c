"""A Spark-native engine for point-in-time research on panel data."""
