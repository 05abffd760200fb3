"""Schemas of the five lake datasets and of the raw catalog frames.

Unsigned 64-bit counters are decimal(20,0): the Parquet reader maps UINT_64 to
that type and no value up to 2^64-1 is lost.
"""

from __future__ import annotations

from pyspark.sql import types as T

COUNTER = T.DecimalType(20, 0)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


def _texts(*names: str) -> list[tuple[str, T.DataType]]:
    return [(name, T.StringType()) for name in names]


def _counters(*names: str) -> list[tuple[str, T.DataType]]:
    return [(name, COUNTER) for name in names]


METRICS = _struct(*_texts("instance_id", "cluster_id", "metric_name"), ("value", T.DoubleType()), *_texts("timestamp"))

QUERY_DIGESTS = _struct(
    *_texts("instance_id", "cluster_id", "digest", "digest_text", "schema_name"),
    *_counters(
        "exec_count", "sum_timer_wait", "sum_rows_examined", "sum_rows_sent", "sum_rows_affected",
        "sum_created_tmp_tables", "sum_created_tmp_disk_tables", "sum_no_index_used",
    ),
    *_texts("first_seen", "last_seen", "timestamp"),
)

INDEX_USAGE = _struct(
    *_texts("instance_id", "cluster_id", "schema_name", "table_name", "index_name"),
    *_counters("count_read", "count_write"),
    *_texts("timestamp"),
)

SAMPLES = _struct(
    *_texts("instance_id", "cluster_id"),
    *_counters("event_id"),
    *_texts("digest", "sql_text"),
    *_counters(
        "timer_wait", "rows_examined", "rows_sent", "rows_affected",
        "created_tmp_tables", "created_tmp_disk_tables", "no_index_used",
    ),
    *_texts("current_schema", "timestamp"),
)

WAIT_EVENTS = _struct(
    *_texts("instance_id", "cluster_id", "parent_digest", "event_name"),
    *_counters("count", "total_wait"),
    *_texts("timestamp"),
)

# Folder name of a dataset -> schema of its rows.
DATASETS: dict[str, T.StructType] = {
    "metrics": METRICS,
    "query-digests": QUERY_DIGESTS,
    "index-usage": INDEX_USAGE,
    "samples": SAMPLES,
    "wait-events": WAIT_EVENTS,
}

RAW_WAITS = _struct(
    *_texts("instance_id", "cluster_id"),
    *_counters("event_id", "thread_id", "nesting_event_id"),
    *_texts("event_name"),
    *_counters("timer_wait", "timer_start"),
    *_texts("operation", "source", "timestamp"),
)

VARIABLES = _struct(*_texts("instance_id", "variable_name", "variable_value"))
