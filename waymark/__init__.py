"""Waymark: a Spark-native engine for address-style records."""
