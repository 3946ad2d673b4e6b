"""Spark-native code-graph analytics and training-data operators."""
