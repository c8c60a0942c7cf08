"""Telemetry analytics on Spark: a bounded pipeline language, rollups, ingest and alerts as DataFrames."""
