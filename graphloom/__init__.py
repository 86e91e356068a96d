"""A Spark-native engine over a property graph, dense vectors, typed memories and an append-only log."""
