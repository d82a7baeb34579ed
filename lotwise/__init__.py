"""Spark-native analytics for property listings captured from result pages."""
