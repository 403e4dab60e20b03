"""Spark-native census and event analytics, and operators for training corpora."""
