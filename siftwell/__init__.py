"""siftwell: Spark-native retrieval analytics over document collections."""

__version__ = "0.1.0"
