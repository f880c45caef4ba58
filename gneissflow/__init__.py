"""A Spark-native engine for repository analytics and large text corpora."""
