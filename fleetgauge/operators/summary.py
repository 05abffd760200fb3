"""Health summary, one nested row per server."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import is_user_schema
from ..functions.parse import clamped_int_sql, float_or_zero_sql
from ..sources.variables import variable_columns

# Variables shown in a summary, in this order.
KEY_VARIABLES = (
    "innodb_buffer_pool_size",
    "max_connections",
    "innodb_log_file_size",
    "innodb_flush_method",
    "innodb_file_per_table",
    "slow_query_log",
    "long_query_time",
)

# Field of the summary -> status counter behind it.
INNODB_COUNTERS = {
    "rows_read": "innodb_rows_read",
    "rows_inserted": "innodb_rows_inserted",
    "rows_updated": "innodb_rows_updated",
    "rows_deleted": "innodb_rows_deleted",
    "row_lock_waits": "innodb_row_lock_waits",
    "row_lock_time_ms": "innodb_row_lock_time",
    "deadlocks": "innodb_deadlocks",
}
POOL_COUNTERS = {
    "total_pages": "innodb_buffer_pool_pages_total",
    "free_pages": "innodb_buffer_pool_pages_free",
    "dirty_pages": "innodb_buffer_pool_pages_dirty",
    "read_requests": "innodb_buffer_pool_read_requests",
    "reads": "innodb_buffer_pool_reads",
}
STATUS = ("uptime", "questions", "threads_running", "threads_connected", "connections", "aborted_connects",
          *POOL_COUNTERS.values(), *INNODB_COUNTERS.values())
VARIABLE = "var_"


def schema_sizes(tables: DataFrame) -> DataFrame:
    """(instance_id, schema, tables, size_bytes) of user schemas; views count, and a table
    with an unknown part adds nothing to the size."""
    return tables.filter(is_user_schema(F.col("table_schema"))).groupBy(
        "instance_id", F.col("table_schema").alias("schema")).agg(
        F.count("*").alias("tables"),
        F.coalesce(F.sum(F.col("data_length") + F.col("index_length")), F.lit(0)).cast("bigint").alias("size_bytes"))


def _ints(**fields: str) -> str:
    """Arguments of named_struct: field -> status or variable column, read as a clamped integer."""
    return ", ".join(f"'{name}', {clamped_int_sql(column)}" for name, column in fields.items())


def uptime_and_rate() -> list[Column]:
    uptime = clamped_int_sql("uptime")
    return [F.expr(f"{uptime} AS uptime_seconds"),
            F.expr(f"CASE WHEN {uptime} > 0 THEN {float_or_zero_sql('questions')} / {uptime} ELSE 0D END AS qps")]


def connection_stats() -> Column:
    sleeping = f"{clamped_int_sql('threads_connected')} - {clamped_int_sql('threads_running')}"
    return F.expr("named_struct({}, {}, 'current_sleeping', {}, {}) AS connections".format(
        _ints(max_connections=VARIABLE + "max_connections"), _ints(current_active="threads_running"), sleeping,
        _ints(total_connections="connections", aborted_connects="aborted_connects")))


def buffer_pool_stats() -> Column:
    requests, reads = (clamped_int_sql(POOL_COUNTERS[name]) for name in ("read_requests", "reads"))
    ratio = f"CASE WHEN {requests} > 0 THEN (1D - double({reads}) / double({requests})) * 100 ELSE 0D END"
    return F.expr("named_struct({}, {}, 'hit_ratio_pct', {}) AS buffer_pool".format(
        _ints(size_bytes=VARIABLE + "innodb_buffer_pool_size"), _ints(**POOL_COUNTERS), ratio))


def innodb_stats() -> Column:
    return F.expr(f"named_struct({_ints(**INNODB_COUNTERS)}) AS innodb")


def key_variables() -> Column:
    """The key variables a server has, as a map."""
    pairs = ", ".join(f"'{name}', {VARIABLE}{name}" for name in KEY_VARIABLES)
    return F.expr(f"map_filter(map({pairs}), (name, value) -> value IS NOT NULL) AS key_variables")


def status_stats(status: DataFrame, variables: DataFrame) -> DataFrame:
    """(instance_id, uptime_seconds, qps, connections, buffer_pool, innodb, key_variables).

    A server appears when either frame has it; what is missing counts as zero.
    """
    counters = variable_columns(status, STATUS)
    settings = variable_columns(variables, KEY_VARIABLES, prefix=VARIABLE)
    both = counters.join(settings, "instance_id", "full_outer")
    return both.select("instance_id", *uptime_and_rate(), connection_stats(), buffer_pool_stats(), innodb_stats(),
                       key_variables())


def fleet_summary(
    servers: DataFrame, status: DataFrame, variables: DataFrame, replication: DataFrame, engines: DataFrame,
    tables: DataFrame,
) -> DataFrame:
    """One row per server of `servers` (instance_id, version).

    `status` and `variables` are raw name/value rows, `tables` raw table rows,
    `replication` and `engines` the frames of those sources. All parts are
    aggregates per instance, so the joins reuse their partitioning. Lists hold
    what one server has: its engines, its schemas.
    """
    supported = engines.groupBy("instance_id").agg(
        F.sort_array(F.collect_list(F.struct("engine", "support", "transactions"))).alias("engines"))
    largest_first = F.struct((-F.col("size_bytes")).alias("order"), "schema",
                             F.struct("schema", "tables", "size_bytes").alias("entry"))
    sizes = schema_sizes(tables).groupBy("instance_id").agg(
        F.sort_array(F.collect_list(largest_first))["entry"].alias("schema_stats"))
    state = replication.select("instance_id", F.struct(
        "is_replica", "slave_io_running", "slave_sql_running", "seconds_behind_master").alias("replication"))
    row = servers.select("instance_id", "version")
    for part in (status_stats(status, variables), state, supported, sizes):
        row = row.join(part, "instance_id", "left")
    return row.select("instance_id", "version", "uptime_seconds", "qps", "connections", "buffer_pool", "innodb",
                      "replication", "engines", "schema_stats", "key_variables")
