"""Queries over telemetry derived from the given tables, and their SQL twins."""
