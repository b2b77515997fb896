"""Spark-native operators for entity-keyed time series, and for training-data tables."""
