"""A Spark-native engine for source-code intelligence."""
