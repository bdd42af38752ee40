"""Spark-native analytics for corpora of text and Python source."""
