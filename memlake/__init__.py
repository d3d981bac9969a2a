"""Spark-native memory store: retrieval, text analytics, temporal facts and graph operators as DataFrames."""
