"""prismcat: a Spark-native engine for media-catalog analytics."""
