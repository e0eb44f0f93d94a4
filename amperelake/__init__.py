"""Spark-native analytics over vehicle telemetry."""
