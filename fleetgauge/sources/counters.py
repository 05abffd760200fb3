"""The poller: status, process list, InnoDB counters, digests and index I/O."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import float_or_null, is_user_schema, or_empty, utc_text
from ..schemas import COUNTER

CYCLE = ("instance_id", "cluster_id", "timestamp")

# The status counters a poll keeps, spelt as the server does.
CURATED_STATUS = (
    "Queries",
    "Threads_connected",
    "Threads_running",
    "Innodb_buffer_pool_reads",
    "Innodb_buffer_pool_read_requests",
    "Innodb_rows_read",
    "Innodb_rows_inserted",
    "Innodb_rows_updated",
    "Innodb_rows_deleted",
    "Connections",
    "Aborted_connects",
    "Slow_queries",
    "Uptime",
)


def _metric(name: Column, value: Column, keys: Sequence[str]) -> list[Column]:
    return [*(F.col(key) for key in keys), name.alias("metric_name"), value.cast("double").alias("value")]


def global_status_metrics(raw: DataFrame, keys: Sequence[str] = CYCLE) -> DataFrame:
    """Curated status rows as metrics; names match with their case, malformed values drop out."""
    curated = raw.filter(F.col("variable_name").isin(*CURATED_STATUS))
    name = F.concat(F.lit("global_status."), F.col("variable_name"))
    return curated.select(*_metric(name, float_or_null("variable_value"), keys)).filter("value IS NOT NULL")


def processlist_metrics(raw: DataFrame, keys: Sequence[str] = CYCLE) -> DataFrame:
    """Total, not sleeping and sleeping threads, three metric rows per snapshot.

    A NULL command is counted in the total alone, as SQL's three-valued logic has it.
    """
    counts = raw.groupBy(*keys).agg(
        F.count("*").cast("double").alias("processlist.total"),
        F.count_if(F.col("command") != "Sleep").cast("double").alias("processlist.active"),
        F.count_if(F.col("command") == "Sleep").cast("double").alias("processlist.sleeping"),
    )
    names = ["`processlist.total`", "`processlist.active`", "`processlist.sleeping`"]
    return counts.unpivot(list(keys), names, "metric_name", "value")


def innodb_metrics(raw: DataFrame, keys: Sequence[str] = CYCLE) -> DataFrame:
    """Enabled InnoDB counters as metrics."""
    name = F.concat(F.lit("innodb_metrics."), F.col("name"))
    return raw.filter(F.col("status") == "enabled").select(*_metric(name, F.col("count"), keys))


def poll_metrics(*sources: DataFrame) -> DataFrame:
    """Metric rows of all sources that could be read in a cycle; failed ones are left out by the caller."""
    return reduce(DataFrame.unionByName, sources)


def digest_top(raw: DataFrame, keys: Sequence[str] = CYCLE, top: int = 100) -> DataFrame:
    """The `top` digests of every snapshot by total wait, ties by schema and digest.

    Spark keeps the first `top` rows per group in each task before the shuffle,
    so a hot snapshot never travels whole.
    """
    counters = {
        "exec_count": "count_star", "sum_timer_wait": "sum_timer_wait", "sum_rows_examined": "sum_rows_examined",
        "sum_rows_sent": "sum_rows_sent", "sum_rows_affected": "sum_rows_affected",
        "sum_created_tmp_tables": "sum_created_tmp_tables",
        "sum_created_tmp_disk_tables": "sum_created_tmp_disk_tables", "sum_no_index_used": "sum_no_index_used",
    }
    typed = raw.filter(F.col("digest").isNotNull() & (F.col("count_star") > 0)).select(
        *keys, "digest",
        or_empty(F.col("digest_text")).alias("digest_text"), or_empty(F.col("schema_name")).alias("schema_name"),
        *(F.col(source).cast(COUNTER).alias(name) for name, source in counters.items()),
        or_empty(utc_text(F.col("first_seen"))).alias("first_seen"),
        or_empty(utc_text(F.col("last_seen"))).alias("last_seen"),
    )
    order = W.partitionBy(*keys).orderBy(F.desc("sum_timer_wait"), "schema_name", "digest")
    return typed.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= top).drop("_rank")


def index_usage(raw: DataFrame, keys: Sequence[str] = CYCLE) -> DataFrame:
    """Read and write counters of named indexes outside the system schemas."""
    named = raw.filter(F.col("index_name").isNotNull() & is_user_schema(F.col("object_schema")))
    return named.select(
        *keys, F.col("object_schema").alias("schema_name"), F.col("object_name").alias("table_name"), "index_name",
        F.col("count_read").cast(COUNTER).alias("count_read"), F.col("count_write").cast(COUNTER).alias("count_write"),
    )
