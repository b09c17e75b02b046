"""Spark-native detection and masking of personal data in large text collections."""
