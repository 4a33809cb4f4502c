"""Spark-native analytics over industrial process time series."""
