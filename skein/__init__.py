"""skein: a Spark-native engine for track, similarity and corpus analytics."""

__version__ = "0.1.0"
