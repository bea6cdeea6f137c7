"""Spark-native text annotation and analytics."""
