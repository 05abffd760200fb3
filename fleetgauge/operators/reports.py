"""The documented analyses.

Orders end with key columns: results are repeatable, and rows that agree on the
reported value still spread over the tasks of a sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import picos_to_ms, picos_to_seconds, prefix

DIGEST_KEYS = ("instance_id", "schema_name", "digest", "timestamp")
INDEX_KEYS = ("instance_id", "schema_name", "table_name", "index_name", "timestamp")


def _query_text() -> Column:
    return prefix(F.col("digest_text"), 80).alias("query")


def top_queries(digests: DataFrame, limit: int = 10) -> DataFrame:
    """Statements by total wait, with seconds and average milliseconds."""
    wait, runs = F.col("sum_timer_wait").cast("double"), F.col("exec_count").cast("double")
    return digests.orderBy(F.desc("sum_timer_wait"), *DIGEST_KEYS).limit(limit).select(
        _query_text(), "exec_count", picos_to_seconds(wait).alias("total_wait_sec"),
        picos_to_ms(F.try_divide(wait, runs)).alias("avg_ms"), "sum_rows_examined",
    )


def _digests_by(digests: DataFrame, counter: str, limit: int) -> DataFrame:
    found = digests.filter(F.col(counter) > 0).orderBy(F.desc(counter), *DIGEST_KEYS).limit(limit)
    return found.select(_query_text(), "exec_count", counter)


def tmp_disk_queries(digests: DataFrame, limit: int = 10) -> DataFrame:
    """Statements that made temporary tables on disk."""
    return _digests_by(digests, "sum_created_tmp_disk_tables", limit)


def no_index_queries(digests: DataFrame, limit: int = 10) -> DataFrame:
    """Statements that ran without an index."""
    return _digests_by(digests, "sum_no_index_used", limit)


def largest_digests(digests: DataFrame, limit: int = 10) -> DataFrame:
    """The `limit` rows with the most wait time, three columns."""
    ordered = digests.orderBy(F.desc("sum_timer_wait"), *DIGEST_KEYS).limit(limit)
    return ordered.select("digest_text", "exec_count", "sum_timer_wait")


def unused_indexes(usage: DataFrame) -> DataFrame:
    """Secondary indexes that were never read, most written first."""
    found = usage.filter((F.col("count_read") == 0) & (F.col("index_name") != "PRIMARY"))
    return found.orderBy(F.desc("count_write"), *INDEX_KEYS).select(
        "schema_name", "table_name", "index_name", "count_read", "count_write")


def most_read_indexes(usage: DataFrame, limit: int = 20) -> DataFrame:
    return usage.orderBy(F.desc("count_read"), *INDEX_KEYS).limit(limit).select(
        "schema_name", "table_name", "index_name", "count_read", "count_write")


def write_heavy_indexes(usage: DataFrame, more_than: int = 1_000_000, limit: int = 20) -> DataFrame:
    """Indexes with many writes and their write/read ratio as text, UNUSED without a read."""
    reads, writes = F.col("count_read").cast("double"), F.col("count_write").cast("double")
    ratio = F.round(F.try_divide(writes, reads), 2)
    # A double of ten million and more would print with an exponent.
    plain = F.when(ratio < 1e7, ratio.cast("string")).otherwise(ratio.cast("decimal(30,1)").cast("string"))
    label = F.when(F.col("count_read") == 0, F.lit("UNUSED")).otherwise(plain)
    heavy = usage.filter(F.col("count_write") > more_than).orderBy(F.desc("count_write"), *INDEX_KEYS).limit(limit)
    return heavy.select(
        "schema_name", "table_name", "index_name", "count_write", "count_read", label.alias("write_read_ratio"))


def all_metrics(metrics: DataFrame) -> DataFrame:
    """Every metric row, newest first."""
    return metrics.orderBy(F.desc("timestamp"), "metric_name", "instance_id").select("metric_name", "value", "timestamp")


def metric_series(metrics: DataFrame, name: str = "global_status.Threads_running") -> DataFrame:
    """One metric over time."""
    return metrics.filter(F.col("metric_name") == name).orderBy("timestamp", "instance_id").select("timestamp", "value")


def metric_like(metrics: DataFrame, pattern: str = "global_status.Innodb_rows_%") -> DataFrame:
    """Metrics whose name matches a LIKE pattern (`_` is any one character), highest first."""
    found = metrics.filter(F.col("metric_name").like(pattern))
    ordered = found.orderBy(F.desc("value"), "metric_name", "instance_id", "timestamp")
    return ordered.select("metric_name", "value")


def instance_queries(metrics: DataFrame, name: str = "global_status.Queries") -> DataFrame:
    return metrics.filter(F.col("metric_name") == name).orderBy("instance_id", "timestamp").select(
        "instance_id", F.col("value").alias("queries"))


def instance_connections(metrics: DataFrame, name: str = "global_status.Threads_connected") -> DataFrame:
    """Connections per instance, most first."""
    return metrics.filter(F.col("metric_name") == name).orderBy(F.desc("value"), "instance_id", "timestamp").select(
        "instance_id", F.col("value").alias("threads_connected"))


def _wait_sums(waits: DataFrame, count_name: str, wait_name: str) -> DataFrame:
    return waits.groupBy("event_name").agg(
        F.sum("count").alias(count_name), picos_to_seconds(F.sum("total_wait")).alias(wait_name),
    ).orderBy(F.desc(wait_name), "event_name")


def wait_totals(waits: DataFrame, limit: int = 20) -> DataFrame:
    """Wait events by total wait time."""
    return _wait_sums(waits, "total_count", "total_wait_sec").limit(limit)


def wait_for_digest(waits: DataFrame, digest: str) -> DataFrame:
    """Wait events of the statements with one digest."""
    return _wait_sums(waits.filter(F.col("parent_digest") == digest), "count", "wait_sec")
