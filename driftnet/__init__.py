"""Spark-native analytics over captured peer-to-peer discovery traffic."""

__version__ = "0.1.0"
