"""A Spark-native engine for multilingual text retrieval and content quality."""
