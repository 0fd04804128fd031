"""Spark-native content inspection engine."""
