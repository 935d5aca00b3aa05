"""Spark-native analytics over property graphs, textual memory and event telemetry."""

__version__ = "0.1.0"
