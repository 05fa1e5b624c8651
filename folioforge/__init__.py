"""Spark-native document corpus engine."""
