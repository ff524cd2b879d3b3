"""A Spark-native engine for content deduplication and producer/consumer performance analysis."""
