"""Workload-telemetry reports as PySpark DataFrame operators."""
