"""Spark-native analytics for corpora of utterances, documents and run logs."""
