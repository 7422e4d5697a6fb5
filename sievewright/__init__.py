"""Spark-native analytics for understanding, labelling and governing message corpora."""
