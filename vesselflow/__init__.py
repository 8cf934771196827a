"""Spark-native analytics over ship-position (AIS) messages."""
