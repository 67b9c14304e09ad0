"""Telemetry analytics on Spark: sources, a small strict query language, pruning and streaming."""
