"""leafmill: a Spark-native engine for document, layout and translation data."""
