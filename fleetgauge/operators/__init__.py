"""Analyses over typed telemetry frames."""

from .advisor import by_severity, check_variables, findings_by_category, rule_context, rule_runs
from .deltas import counter_delta, counter_delta_fleet, counter_increase
from .drift import schema_drift
from .health import all_failing_spans, health_streaks, poll_outcome
from .indexes import duplicate_indexes
from .isolation import isolated
from .membership import topology_diff
from .reports import (
    all_metrics, instance_connections, instance_queries, largest_digests, metric_like, metric_series,
    most_read_indexes, no_index_queries, tmp_disk_queries, top_queries, unused_indexes, wait_for_digest,
    wait_totals, write_heavy_indexes,
)
from .rollups import add_daily_bounds, counter_delta_daily, daily_bounds, fold_daily_bounds, read_daily_bounds
from .sampling import buffer_lifespan, sampling_advice
from .schema_docs import assemble_schemas
from .skew import cut_points, hot_keys, spread_join
from .snapshots import latest_in_lake, latest_per_instance, latest_snapshot, snapshot_at, snapshot_times
from .summary import fleet_summary, schema_sizes, status_stats
from .waits import aggregate_waits, correlate_waits, sample_digests, wait_summary

__all__ = [
    "add_daily_bounds", "aggregate_waits", "all_failing_spans", "all_metrics", "assemble_schemas", "buffer_lifespan", "by_severity",
    "check_variables", "correlate_waits", "counter_delta", "counter_delta_daily", "counter_delta_fleet",
    "counter_increase", "cut_points", "daily_bounds",
    "duplicate_indexes", "findings_by_category", "fleet_summary", "fold_daily_bounds", "health_streaks", "hot_keys",
    "instance_connections", "instance_queries", "isolated", "largest_digests", "latest_in_lake", "latest_per_instance", "latest_snapshot",
    "metric_like", "metric_series", "most_read_indexes", "no_index_queries", "poll_outcome", "read_daily_bounds", "rule_context",
    "rule_runs", "sample_digests", "sampling_advice", "schema_drift", "schema_sizes", "snapshot_at",
    "snapshot_times", "spread_join", "status_stats", "tmp_disk_queries", "top_queries", "topology_diff",
    "unused_indexes", "wait_for_digest", "wait_summary", "wait_totals", "write_heavy_indexes",
]
