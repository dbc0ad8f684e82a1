"""A Spark-native engine for retrieval, code-graph and activity analytics."""
