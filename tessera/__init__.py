"""Spark-native data integration and analytics."""
