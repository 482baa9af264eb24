"""A Spark-native engine for matching small labelled patterns against a property graph."""
