"""A Spark-native engine for tables that mix vectors with ordinary columns."""
