"""Operators over telemetry tables: storage, catalog and pruning, indexes, codec size model."""
