"""Spark-native analytics for web, catalog and quality-audit data."""
