"""Spark-native secret detection, scoring and redaction engine."""
