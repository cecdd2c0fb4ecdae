"""A PySpark-native engine for review, basket, graph, stream and clustering analytics."""
