"""Spark-native analytics over fleet telemetry: ingestion, health rules, capacity, alerts and maintenance plans."""
