"""Spark-native document-intelligence engine."""
