"""Spark-native fleet telemetry analytics: features, labels, detectors,
evaluation, alerting and reports over a per-host metrics table."""

__version__ = "0.1.0"
