"""chunkwell: Spark-native document chunking, retrieval and prompt assembly."""

__version__ = "0.1.0"
