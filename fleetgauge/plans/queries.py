"""One query per operator, over whole tables; names follow the operator inventory.

Results are flat: arrays are joined to text and counters are long, so that a
SQL engine can state the same result.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as fn
from .. import operators as op
from .. import sinks, sources, streaming
from ..operators.advisor import severity_rank
from ..rules import RULES
from ..session import run_dir
from .telemetry import Telemetry, digest_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

CYCLE_TIME = "2024-01-01 00:00:00"
SNAPSHOT = "2000-06-01 00:00:00"


def query(build: Callable[[Telemetry], DataFrame]) -> Callable[[Telemetry], DataFrame]:
    """Registers a function of the derived telemetry under its own name."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _flat(build(Telemetry(spark, folder)))
    QUERIES[build.__name__] = run
    return build


def _flat(rows: DataFrame) -> DataFrame:
    """Unsigned counters as long; they are far below its limit in the derived telemetry."""
    wide = [field.name for field in rows.schema if isinstance(field.dataType, T.DecimalType)]
    return rows.withColumns({name: F.col(f"`{name}`").cast("bigint") for name in wide}) if wide else rows


def _joined(items: Column, separator: str = ",") -> Column:
    return F.array_join(items, separator, "NULL")


def _rule_columns() -> list[str]:
    return ["instance_id", "rule_id", "category", "severity", "variable", "current_value"]


# --- sources ---------------------------------------------------------------

@query
def read_raw(t: Telemetry) -> DataFrame:
    """Landed rows of two servers' catalogs as one cycle."""
    frames = [
        sources.landed.tagged(sources.read_landed(t.spark, f"{t.folder}/{name}.parquet"), f"inst-{name}", "cl-0", CYCLE_TIME)
        for name in ("customer", "supplier")
    ]
    return sources.union_instances(frames).select("instance_id", "cluster_id", "timestamp", "c_custkey", "s_suppkey")


@query
def global_variables(t: Telemetry) -> DataFrame:
    maps = sources.global_variables(t.global_variables())
    return maps.select("instance_id", F.explode("vars").alias("name", "value"))


@query
def show_to_map(t: Telemetry) -> DataFrame:
    maps = sources.show_to_map(t.global_status())
    return maps.select("instance_id", F.explode("vars").alias("name", "value"))


@query
def global_status_metrics(t: Telemetry) -> DataFrame:
    return sources.global_status_metrics(t.global_status())


@query
def digest_top100(t: Telemetry) -> DataFrame:
    return sources.digest_top(t.raw_digests())


@query
def index_usage(t: Telemetry) -> DataFrame:
    return sources.index_usage(t.raw_index_io())


@query
def processlist_metrics(t: Telemetry) -> DataFrame:
    return sources.processlist_metrics(t.processlist())


@query
def innodb_metrics(t: Telemetry) -> DataFrame:
    return sources.innodb_metrics(t.innodb_counters())


def _statements(t: Telemetry) -> DataFrame:
    """Statement history with NULLs where the server has them."""
    return t.samples().select(
        "instance_id", "event_id", "thread_id", F.when(F.col("timer_wait") % 10 != 0, F.col("digest")).alias("digest"),
        "sql_text", F.when(F.col("timer_wait") % 3 != 0, F.col("timer_wait")).alias("timer_wait"), "timer_start")


def _marks(events: DataFrame) -> DataFrame:
    """High-water marks in the middle of each instance's events; one instance was never read."""
    middle = events.groupBy("instance_id").agg(F.call_function("div", F.max("event_id"), F.lit(2)).alias("high_water_mark"))
    return middle.filter("instance_id <> 'inst-2'")


@query
def statement_tail(t: Telemetry) -> DataFrame:
    events = _statements(t)
    return sources.statement_tail(events, _marks(events))


@query
def wait_tail(t: Telemetry) -> DataFrame:
    events = t.raw_waits().withColumn("operation", F.lit(None).cast("string"))
    tail = sources.wait_tail(events, _marks(events))
    return tail.select("instance_id", "event_id", "nesting_event_id", "event_name", "timer_wait", "operation")


@query
def high_water_marks(t: Telemetry) -> DataFrame:
    events = t.raw_waits()
    marks = _marks(events)
    return sources.high_water_marks(sources.wait_tail(events, marks), marks)


@query
def buffer_bounds(t: Telemetry) -> DataFrame:
    return sources.buffer_bounds(_statements(t))


@query
def topology(t: Telemetry) -> DataFrame:
    return sources.topology(t.clusters(), t.replica_hosts())


@query
def host_identity(t: Telemetry) -> DataFrame:
    servers = t.table("customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 7 == 0, F.col("c_name")).otherwise(F.lit("")).alias("override"),
        F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("aurora-"), "c_custkey")).alias("aurora"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.col("c_mktsegment")).alias("host"))
    name = sources.host_identity(F.col("override"), F.col("aurora"), F.col("host"), F.lit("127.0.0.1"))
    return servers.select("c_custkey", name.alias("identity"))


@query
def index_catalog(t: Telemetry) -> DataFrame:
    indexes = sources.index_catalog(t.index_rows())
    return indexes.withColumn("columns", _joined(F.col("columns")))


@query
def table_catalog(t: Telemetry) -> DataFrame:
    return sources.table_catalog(t.table_rows())


@query
def column_catalog(t: Telemetry) -> DataFrame:
    columns = sources.column_catalog(t.column_rows())
    text = F.transform("columns", lambda c: F.concat_ws(
        ":", c["position"].cast("string"), c["name"], c["column_type"], c["is_nullable"].cast("string"), c["column_key"],
        F.coalesce(c["default_value"], F.lit("none")), c["character_set"], c["collation"]))
    return columns.select("instance_id", "schema_name", "table_name", F.size("columns").alias("n_columns"),
                          _joined(text, ";").alias("columns"))


@query
def engines(t: Telemetry) -> DataFrame:
    return sources.engines(t.engine_rows())


@query
def replica_status(t: Telemetry) -> DataFrame:
    return sources.replica_status(t.servers(), t.replica_rows())


@query
def server_info(t: Telemetry) -> DataFrame:
    return sources.server_info(t.servers())


def _lake(t: Telemetry, purpose: str) -> str:
    """A lake with the digest rows, filled in on the first day of the next year, and the index rows of one day."""
    base = run_dir(t.spark, purpose)
    day = F.make_date(F.substring("timestamp", 1, 4).cast("int") + 1, F.lit(1), F.lit(1))
    sinks.write_lake(_wide(t.query_digests(), "query-digests"), base, "query-digests", date=day)
    sinks.write_lake(t.index_usage(), base, "index-usage", date=dt.date(2024, 1, 2))
    return base


def _wide(rows: DataFrame, dataset: str) -> DataFrame:
    """The columns a dataset has and the derived rows lack, as NULL."""
    missing = [f for f in sources.lake.DATASETS[dataset].fields if f.name not in rows.columns]
    return rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}) if missing else rows


DIGEST_COLUMNS = ("instance_id", "cluster_id", "digest", "digest_text", "schema_name", "exec_count", "sum_timer_wait",
                  "sum_rows_examined", "timestamp")


@query
def read_lake(t: Telemetry) -> DataFrame:
    base = _lake(t, "read-lake")
    digests = sources.read_lake(t.spark, base, "query-digests")
    usage = sources.read_lake(t.spark, base, "index-usage")
    return digests.select("instance_id", "timestamp", F.col("digest").alias("name"), F.col("exec_count").alias("value")).unionByName(
        usage.select("instance_id", "timestamp", F.concat_ws(".", "schema_name", "table_name", "index_name").alias("name"),
                     F.col("count_write").alias("value")))


@query
def read_lake_date_range(t: Telemetry) -> DataFrame:
    rows = sources.read_lake(t.spark, _lake(t, "read-range"), "query-digests", since="1998-01-01", until="1998-12-31")
    return rows.select(*DIGEST_COLUMNS)


# --- sinks -----------------------------------------------------------------

@query
def write_lake(t: Telemetry) -> DataFrame:
    rows = sources.read_lake(t.spark, _lake(t, "write-lake"), "query-digests")
    return rows.select(*DIGEST_COLUMNS, F.col("date").cast("string").alias("date"))


@query
def write_lake_sized(t: Telemetry) -> DataFrame:
    """Samples in files of at most 1000 rows; how many rows each instance has, and whether the limit held."""
    base = run_dir(t.spark, "sized")
    sinks.write_lake(_wide(t.samples(), "samples"), base, "samples", rows_per_file=1000)
    files = sources.read_lake(t.spark, base, "samples").groupBy(
        "instance_id", F.input_file_name().alias("file")).agg(F.count("*").alias("n"))
    return files.groupBy("instance_id").agg(F.sum("n").alias("n_rows"), (F.max("n") <= 1000).alias("within_limit"))


@query
def compact_lake(t: Telemetry) -> DataFrame:
    """Two appends, then one rewrite: the same rows, one file per folder."""
    base = run_dir(t.spark, "compact-lake")
    rows, day = _wide(t.samples(), "samples"), F.to_date(F.lit("2024-01-01"))
    for urgent in (True, False):
        part = rows.filter((F.col("digest") == digest_of(F.lit(1))) == urgent)
        sinks.write_lake(part, base, "samples", date=day)
    sinks.compact_lake(t.spark, base, "samples")
    read = sources.read_lake(t.spark, base, "samples").withColumn("file", F.input_file_name())
    return read.groupBy("instance_id").agg(
        F.count("*").alias("n_rows"), F.sum("timer_wait").alias("timer_wait"),
        (F.count_distinct("file") <= 1 + F.count("*") / 1_000_000).alias("compacted"))


def _envelopes(t: Telemetry, per_table: bool = True) -> DataFrame:
    instances, hot = t.servers().select("instance_id", "cluster_id"), _large_instances(t)
    made = sinks.payloads(
        instances, findings=op.check_variables(t.global_variables()), duplicates=_duplicates(t), summaries=_summary(t),
        schemas=_documents(t, instances), hot=hot, per_table=per_table,
        cuts=None if per_table else op.cut_points(t.table_rows(), ["instance_id"], ["table_schema", "table_name"]))
    return sinks.envelopes(instances, made, CYCLE_TIME, seed="a seed", hot=hot)


def _large_instances(t: Telemetry) -> DataFrame:
    return op.hot_keys(t.table_rows(), ["instance_id"])


@query
def envelopes(t: Telemetry) -> DataFrame:
    """Envelopes per instance and tool, one of all index findings: how many, with how many findings, and whether the run id is shared."""
    finding = F.get_json_object("json_payload", "$.findings")
    listed = F.size(F.from_json(finding, "array<string>"))
    keys = ("instance_id", "cluster_id", "tool", "tool_version", "collected_at")
    # An envelope has each of its parts once.
    parts = _envelopes(t, per_table=False).groupBy(*keys, "part").agg(
        F.count("*").alias("n"), F.sum(F.when(finding.isNotNull(), listed).otherwise(F.lit(0))).alias("n_findings"),
        F.min("run_id").alias("least"), F.max("run_id").alias("greatest"),
        F.bool_and(F.col("run_id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")).alias("v4"))
    return parts.groupBy(*keys).agg(
        F.max("n").alias("n"), F.sum("n_findings").alias("n_findings"), (F.min("least") == F.max("greatest")).alias("one_run"),
        F.bool_and("v4").alias("v4"))


@query
def envelope_payloads(t: Telemetry) -> DataFrame:
    """The texts of the index findings, one message per table."""
    instances, hot = t.servers().select("instance_id", "cluster_id"), _large_instances(t)
    made = sinks.envelopes(instances, sinks.payloads(instances, duplicates=_duplicates(t), hot=hot), CYCLE_TIME, seed="a seed", hot=hot)
    return made.select("instance_id", "tool", "json_payload")


@query
def run_all(t: Telemetry) -> DataFrame:
    """Four tools of which one fails while it runs: messages per instance and tool, and the failure."""
    instances = t.servers().select("instance_id", "cluster_id")
    messages, failures = sinks.run_tools(instances, {
        "findings": lambda: op.check_variables(t.global_variables()), "duplicates": lambda: _duplicates(t),
        "summaries": lambda: _summary(t).withColumn("version", F.raise_error(F.lit("the server has gone away"))),
        "schemas": lambda: _documents(t, instances)}, CYCLE_TIME, seed="a seed", hot=_large_instances(t))
    sent = messages.groupBy("instance_id", "tool").agg(F.count("*").alias("n"), F.lit(None).cast("string").alias("error"))
    reason = F.regexp_extract("error", "the server has gone away", 0)
    return sent.unionByName(failures.select(F.lit(None).cast("string").alias("instance_id"), F.col("name").alias("tool"),
                                            F.lit(0).cast("bigint").alias("n"), reason.alias("error")))


@query
def topic_routing(t: Telemetry) -> DataFrame:
    """Messages written to a folder per topic and read from there; events stand for messages, some of unknown tools."""
    tools = {"view": "pt-variable-advisor", "click": "pt-duplicate-key-checker", "error": "pt-mysql-summary",
             "signup": "table-schema"}
    tool = F.col("event_type")
    for event, name in tools.items():
        tool = F.when(F.col("event_type") == event, F.lit(name)).otherwise(tool)
    messages = t.table("events").select(F.col("event_id").cast("string").alias("run_id"), tool.alias("tool"))
    path = run_dir(t.spark, "topics")
    sinks.write_envelopes(messages, path)
    read = t.spark.read.option("partitionColumnTypeInference.enabled", "false").parquet(path)
    return read.select("run_id", "tool", F.coalesce(F.col("topic").cast("string"), F.lit("")).alias("topic"))


@query
def json_report(t: Telemetry) -> DataFrame:
    """Replication reports written as JSON lines; null fields stay in the text."""
    path = run_dir(t.spark, "report")
    sinks.write_report(sources.replica_status(t.servers(), t.replica_rows()), path)
    lines = t.spark.read.text(path)
    return lines.select(
        F.get_json_object("value", "$.instance_id").alias("instance_id"),
        F.contains("value", F.lit('"seconds_behind_master":null')).alias("lag_is_null"),
        F.get_json_object("value", "$.seconds_behind_master").cast("bigint").alias("lag"))


# --- projections and predicates --------------------------------------------

@query
def exclude_system_schemas(t: Telemetry) -> DataFrame:
    return t.table_rows().filter(fn.is_user_schema(F.col("table_schema"))).select("instance_id", "table_schema", "table_name")


@query
def rule_check(t: Telemetry) -> DataFrame:
    return op.check_variables(t.global_variables()).select(*_rule_columns(), "ordinal")


@query
def category_filter(t: Telemetry) -> DataFrame:
    return op.check_variables(t.global_variables(), category="replication").select(*_rule_columns())


@query
def aurora_skip(t: Telemetry) -> DataFrame:
    """Skipped rules per server within one category."""
    return op.rule_runs(t.global_variables(), category="innodb").select("instance_id", "is_aurora", "rules_skipped")


@query
def aurora_downgrade(t: Telemetry) -> DataFrame:
    tagged = [rule.id for rule in RULES if "aurora-downgrade" in rule.tags]
    found = op.check_variables(t.global_variables()).filter(F.col("rule_id").isin(tagged))
    return found.select("instance_id", "rule_id", "severity")


@query
def detect_aurora(t: Telemetry) -> DataFrame:
    return op.rule_context(t.global_variables(), rules=()).select("instance_id", "is_aurora")


@query
def parse_version(t: Telemetry) -> DataFrame:
    context = op.rule_context(t.global_variables(), rules=())
    return context.select(
        "instance_id", "version.major", "version.minor", "version.patch", "version.raw",
        fn.version_at_least("version", 8, 0, 30).alias("at_least_8_0_30"))


@query
def parse_int_var(t: Telemetry) -> DataFrame:
    return t.global_variables().select(
        "instance_id", "variable_name", fn.strict_int("variable_value").alias("value"))


@query
def status_numbers(t: Telemetry) -> DataFrame:
    return t.global_status().select(
        "instance_id", "variable_name", fn.clamped_int("variable_value").alias("as_int"),
        fn.float_or_zero("variable_value").alias("as_float"))


@query
def unused_indexes(t: Telemetry) -> DataFrame:
    return op.unused_indexes(t.index_usage())


@query
def tmp_disk_queries(t: Telemetry) -> DataFrame:
    return op.tmp_disk_queries(t.query_digests())


@query
def no_index_queries(t: Telemetry) -> DataFrame:
    return op.no_index_queries(t.query_digests())


@query
def metric_series(t: Telemetry) -> DataFrame:
    return op.metric_series(t.metrics())


@query
def metric_like(t: Telemetry) -> DataFrame:
    return op.metric_like(t.metrics())


@query
def write_heavy_indexes(t: Telemetry) -> DataFrame:
    return op.write_heavy_indexes(t.index_usage(), more_than=100_000)


@query
def snapshot_at(t: Telemetry) -> DataFrame:
    return op.snapshot_at(t.query_digests(), SNAPSHOT).select(*DIGEST_COLUMNS)


@query
def all_metrics_latest_first(t: Telemetry) -> DataFrame:
    return op.all_metrics(t.metrics())


# --- joins -----------------------------------------------------------------

@query
def correlate_waits(t: Telemetry) -> DataFrame:
    waits = op.correlate_waits(t.raw_waits(), t.samples())
    return waits.select("instance_id", "event_id", "thread_id", "event_name", "timer_wait", "parent_digest")


def _duplicates(t: Telemetry) -> DataFrame:
    return op.duplicate_indexes(sources.index_catalog(t.index_rows()))


@query
def duplicate_keys(t: Telemetry) -> DataFrame:
    return _duplicates(t).withColumn("columns", _joined(F.col("columns")))


def _documents(t: Telemetry, instances: DataFrame | None = None) -> DataFrame:
    """Documents of all tables, or of those of `instances`, which are joined while rows are narrow."""
    tables = sources.table_catalog(t.table_rows())
    if instances is not None:
        tables = tables.join(instances.select("instance_id"), "instance_id")
    return op.assemble_schemas(tables, sources.column_catalog(t.column_rows()), sources.index_catalog(t.index_rows()))


@query
def assemble_schemas(t: Telemetry) -> DataFrame:
    columns = F.transform("columns", lambda c: F.concat_ws(":", c["position"].cast("string"), c["name"]))
    indexes = F.transform("indexes", lambda i: F.concat(i["index_name"], F.lit("("), _joined(i["columns"]), F.lit(")")))
    return _documents(t).select(
        "instance_id", "schema_name", "table_name", "table_rows", "data_length", "index_length", "engine",
        _joined(columns, ";").alias("columns"), _joined(indexes, ";").alias("indexes"))


@query
def latest_snapshot(t: Telemetry) -> DataFrame:
    return op.latest_snapshot(t.query_digests()).select(*DIGEST_COLUMNS)


@query
def latest_per_instance(t: Telemetry) -> DataFrame:
    return op.latest_per_instance(t.metrics())


@query
def latest_in_lake(t: Telemetry) -> DataFrame:
    return op.latest_in_lake(t.spark, _lake(t, "latest"), "query-digests").select(*DIGEST_COLUMNS)


@query
def topology_diff(t: Telemetry) -> DataFrame:
    return op.topology_diff(t.known_members(), t.discovered_members())


@query
def sample_digest_join(t: Telemetry) -> DataFrame:
    joined = op.sample_digests(t.samples(), t.query_digests())
    return joined.select("instance_id", "event_id", "digest", "digest_text", "exec_count", "sum_timer_wait")


@query
def rule_context_join(t: Telemetry) -> DataFrame:
    return op.rule_context(t.global_variables()).select(
        "instance_id", "is_aurora", F.col("version.raw").alias("version"), "text_innodb_flush_method", "text_gtid_mode",
        "int_max_connections", "int_bulk_insert_buffer_size")


def _summary(t: Telemetry) -> DataFrame:
    return op.fleet_summary(
        t.servers(), t.global_status(), t.global_variables(), sources.replica_status(t.servers(), t.replica_rows()),
        sources.engines(t.engine_rows()), t.table_rows())


@query
def summary_assembly(t: Telemetry) -> DataFrame:
    """Every part of the summary in one flat row per server."""
    sizes = F.transform("schema_stats", lambda s: F.concat_ws(
        ":", s["schema"], s["tables"].cast("string"), s["size_bytes"].cast("string")))
    return _summary(t).select(
        "instance_id", "version", "uptime_seconds", "qps", "connections.max_connections", "connections.current_sleeping",
        "buffer_pool.hit_ratio_pct", "innodb.rows_read", "replication.is_replica", "replication.seconds_behind_master",
        _joined(F.col("engines.engine")).alias("engines"), _joined(sizes, ";").alias("schema_stats"),
        F.size("key_variables").alias("n_key_variables"))


# --- aggregations ----------------------------------------------------------

@query
def aggregate_waits(t: Telemetry) -> DataFrame:
    return op.aggregate_waits(op.correlate_waits(t.raw_waits(), t.samples()))


@query
def wait_summary(t: Telemetry) -> DataFrame:
    return op.wait_summary(t.raw_waits(), t.samples())


@query
def schema_sizes(t: Telemetry) -> DataFrame:
    return op.schema_sizes(t.table_rows())


@query
def findings_by_category(t: Telemetry) -> DataFrame:
    grouped = op.findings_by_category(op.check_variables(t.global_variables()))
    return grouped.select("instance_id", "category", "n_findings", _joined(F.col("findings.rule_id")).alias("rules"))


@query
def rule_run(t: Telemetry) -> DataFrame:
    return op.rule_runs(t.global_variables())


@query
def counter_delta(t: Telemetry) -> DataFrame:
    return op.counter_delta(t.query_digests(), SNAPSHOT)


@query
def counter_delta_fleet(t: Telemetry) -> DataFrame:
    return op.counter_delta_fleet(t.query_digests(), SNAPSHOT)


@query
def counter_delta_daily(t: Telemetry) -> DataFrame:
    """Growth from per-day bounds that were added to twice, the second time with rows of the same days."""
    path, rows = run_dir(t.spark, "daily-bounds"), t.query_digests()
    for late in (False, True):
        op.add_daily_bounds(rows.filter((F.crc32("digest") % 3 == 0) == late), path)
    return op.counter_delta_daily(op.read_daily_bounds(t.spark, path), SNAPSHOT)


@query
def counter_increase(t: Telemetry) -> DataFrame:
    """Reset-aware steps (an addition), over counters that begin again in the middle."""
    rows = t.query_digests().withColumn("exec_count", F.when(
        F.col("timestamp") >= SNAPSHOT, F.col("exec_count") % 5).otherwise(F.col("exec_count")))
    return op.counter_increase(rows, ["instance_id", "schema_name", "digest"], ["exec_count"])


@query
def wait_totals(t: Telemetry) -> DataFrame:
    return op.wait_totals(op.wait_summary(t.raw_waits(), t.samples()))


@query
def wait_for_digest(t: Telemetry) -> DataFrame:
    """For the digest a fifth of all statements share."""
    digest = hashlib.md5(b"q1").hexdigest()
    return op.wait_for_digest(op.wait_summary(t.raw_waits(), t.samples(), digest=digest), digest)


@query
def snapshot_times(t: Telemetry) -> DataFrame:
    return op.snapshot_times(t.metrics())


def _stats(t: Telemetry) -> DataFrame:
    return op.status_stats(t.global_status(), t.global_variables())


@query
def qps(t: Telemetry) -> DataFrame:
    return _stats(t).select("instance_id", "uptime_seconds", "qps")


@query
def connection_stats(t: Telemetry) -> DataFrame:
    return _stats(t).select("instance_id", "connections.*")


@query
def buffer_pool_stats(t: Telemetry) -> DataFrame:
    return _stats(t).select("instance_id", "buffer_pool.*")


@query
def innodb_stats(t: Telemetry) -> DataFrame:
    return _stats(t).select("instance_id", "innodb.*")


@query
def key_variables(t: Telemetry) -> DataFrame:
    return _stats(t).select("instance_id", F.explode("key_variables").alias("name", "value"))


@query
def fleet_summary(t: Telemetry) -> DataFrame:
    """The nested parts of the summary, written out per server."""
    return _summary(t).select(
        "instance_id", "connections.*", "buffer_pool.size_bytes", "buffer_pool.read_requests", "innodb.deadlocks",
        "replication.slave_io_running", "replication.slave_sql_running",
        F.to_json(F.col("engines"), {"ignoreNullFields": "false"}).alias("engines"),
        F.to_json(F.col("schema_stats"), {"ignoreNullFields": "false"}).alias("schema_stats"),
        F.element_at("key_variables", F.lit("innodb_flush_method")).alias("flush_method"))


@query
def buffer_lifespan(t: Telemetry) -> DataFrame:
    return op.buffer_lifespan(sources.buffer_bounds(_statements(t)))


@query
def health_streaks(t: Telemetry) -> DataFrame:
    return op.health_streaks(t.poll_log()).select("instance_id", "ts", "failed", "consecutive_fails", "needs_reconnect")


@query
def all_failing_spans(t: Telemetry) -> DataFrame:
    return op.all_failing_spans(t.poll_log(), give_up_after=3600)


@query
def poll_outcome(t: Telemetry) -> DataFrame:
    """Digest snapshots against the months in which metrics and index rows are there too."""
    due = t.query_digests().select("instance_id", "timestamp").distinct().unionByName(
        t.poll_log().select("instance_id", F.col("ts").alias("timestamp")))
    return op.poll_outcome(due, t.metrics(), t.query_digests(), t.index_usage())


# --- sorts, limits, unions -------------------------------------------------

@query
def severity_sort(t: Telemetry) -> DataFrame:
    found = op.by_severity(op.check_variables(t.global_variables()))
    return found.select("instance_id", severity_rank(F.col("severity")).alias("rank"), "ordinal", "rule_id")


@query
def top_queries(t: Telemetry) -> DataFrame:
    return op.top_queries(t.query_digests())


@query
def top_queries_latest(t: Telemetry) -> DataFrame:
    return op.top_queries(op.latest_per_instance(t.query_digests()))


@query
def most_read_indexes(t: Telemetry) -> DataFrame:
    return op.most_read_indexes(t.index_usage())


@query
def instance_queries(t: Telemetry) -> DataFrame:
    return op.instance_queries(t.metrics())


@query
def instance_connections(t: Telemetry) -> DataFrame:
    return op.instance_connections(t.metrics())


@query
def nlargest(t: Telemetry) -> DataFrame:
    return op.largest_digests(t.query_digests())


@query
def union_metrics(t: Telemetry) -> DataFrame:
    return sources.poll_metrics(
        sources.global_status_metrics(t.global_status()), sources.processlist_metrics(t.processlist()),
        sources.innodb_metrics(t.innodb_counters()))


@query
def union_envelopes(t: Telemetry) -> DataFrame:
    """Messages per tool over the fleet."""
    return _envelopes(t).groupBy("tool").agg(F.count("*").alias("n"), F.count_distinct("instance_id").alias("instances"))


@query
def union_instances(t: Telemetry) -> DataFrame:
    """Index and digest frames of single instances, put together again."""
    rows = t.index_usage()
    each = [rows.filter(F.col("instance_id") == f"inst-{i}") for i in range(4)]
    return sources.union_instances(each)


# --- scalar functions ------------------------------------------------------

@query
def case_fold(t: Telemetry) -> DataFrame:
    value = F.col("variable_value")
    return t.global_variables().select(
        "instance_id", "variable_name", fn.equals_fold(value, "ON").alias("is_on"),
        fn.contains_fold(value, "AutoExtend").alias("extends"))


@query
def list_membership(t: Telemetry) -> DataFrame:
    items = fn.list_items("variable_value")
    return t.global_variables().select(
        "instance_id", "variable_name", F.get(items, F.lit(0)).alias("first_item"),
        F.array_contains(items, "TLSv1.2").alias("has_tls12"))


@query
def first_non_empty(t: Telemetry) -> DataFrame:
    wide = sources.variable_columns(t.global_variables(), ["replica_parallel_workers", "slave_parallel_workers"])
    picked = fn.first_non_empty(F.col("replica_parallel_workers"), F.col("slave_parallel_workers"))
    return wide.select("instance_id", picked.alias("workers"))


@query
def five_second_bucket(t: Telemetry) -> DataFrame:
    return t.raw_waits().select("event_id", "thread_id", fn.five_second_bucket(F.col("timestamp")).alias("bucket"))


@query
def utc_text(t: Telemetry) -> DataFrame:
    moment = F.timestamp_seconds(F.lit(1704067200) + F.col("o_orderkey"))
    return t.table("orders").select("o_orderkey", fn.utc_text(moment).alias("text"))


@query
def text_prefix(t: Telemetry) -> DataFrame:
    return t.table("documents").select("doc_id", fn.prefix(F.col("text"), 80).alias("prefix"))


@query
def picosecond_units(t: Telemetry) -> DataFrame:
    wait = F.col("sum_timer_wait")
    return t.query_digests().select("instance_id", "digest", "timestamp", fn.picos_to_seconds(wait).alias("seconds"),
                                    fn.picos_to_ms(wait).alias("ms"))


@query
def quoted_ddl(t: Telemetry) -> DataFrame:
    usage = t.index_usage()
    return usage.select("instance_id", fn.drop_index_ddl(
        F.col("schema_name"), F.col("table_name"), F.col("index_name")).alias("ddl"))


@query
def sampling_advice(t: Telemetry) -> DataFrame:
    """Advice for every server; its statement history spans as many seconds as it has orders."""
    spans = t.table("orders").groupBy(F.concat(F.lit("inst-"), F.col("o_custkey").cast("string")).alias("instance_id")).agg(
        F.lit(1_000_000_000_000).alias("oldest_timer"),
        ((F.count("*") + 1) * 1_000_000_000_000).alias("newest_timer"), F.count("*").alias("row_count"))
    intervals = t.table("customer").select(
        F.concat(F.lit("inst-"), F.col("c_custkey").cast("string")).alias("instance_id"),
        ((1 + F.col("c_custkey") % 60) * 1_000_000_000).alias("interval_ns"))
    return op.sampling_advice(spans, intervals)


@query
def dns_suffix(t: Telemetry) -> DataFrame:
    return t.clusters().select("cluster_id", "endpoint", fn.dns_suffix(F.col("endpoint")).alias("suffix"))


@query
def cluster_of_host(t: Telemetry) -> DataFrame:
    return t.clusters().select("cluster_id", "endpoint", fn.cluster_of_host(F.col("endpoint")).alias("host_cluster"))


@query
def json_encode(t: Telemetry) -> DataFrame:
    body = F.to_json(F.struct("run_id", "tool"), {"ignoreNullFields": "false"})
    messages = t.table("events").select(
        F.col("event_id").cast("string").alias("run_id"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("tool"))
    return messages.select("run_id", body.alias("json"))


# --- streams ---------------------------------------------------------------

def _landed(t: Telemetry, purpose: str, rows: DataFrame, later: Column) -> Callable[[int], DataFrame]:
    """Lands rows in two goes, those of `later` last, and gives the stream of what has landed by a go.

    All are written at once, a folder per go; the first go sees the first folder only, the second one both.
    """
    path = run_dir(t.spark, purpose)
    rows.withColumn("go", F.coalesce(later, F.lit(False)).cast("int")).write.partitionBy("go").parquet(path)
    for go in (0, 1):  # a go may have no rows
        t.spark.createDataFrame([], rows.schema).write.mode("append").parquet(f"{path}/go={go}")
    return lambda go: t.spark.readStream.schema(rows.schema).parquet(f"{path}/go=0" if go == 0 else f"{path}/go=[01]")


def _in_landings(t: Telemetry, purpose: str, rows: DataFrame, later: Column, begin: Callable) -> None:
    """Lands rows in two goes and runs the stream that `begin` starts after each of them."""
    landing = _landed(t, purpose, rows, later)
    for go in (0, 1):
        begin(landing(go)).awaitTermination()


def _timed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("event_time", fn.instant(F.col("timestamp")))


@query
def stream_waits_5s(t: Telemetry) -> DataFrame:
    """Half of the statements land after their waits, and half of the waits after their statements."""
    landings = (
        _landed(t, "waits", _timed(t.raw_waits()), F.col("nesting_event_id") % 4 < 2),
        _landed(t, "statements", _timed(t.samples()), F.col("event_id") % 2 == 0))
    summaries, checkpoint = streaming.WaitSummaries(run_dir(t.spark, "wait-summary"), parts=8), run_dir(t.spark, "waits-checkpoint")
    for go in (0, 1):
        streaming.stream_wait_summary(*(landing(go) for landing in landings), summaries, checkpoint, once=True).awaitTermination()
    return summaries.summary(t.spark)


@query
def stream_tail(t: Telemetry) -> DataFrame:
    """Everything twice: the whole history lands again in the second go, with new events behind it."""
    rows = t.raw_waits()
    tail = streaming.EventTail(run_dir(t.spark, "tail"), parts=8)
    checkpoint = run_dir(t.spark, "tail-checkpoint")
    middle = rows.groupBy("instance_id", "thread_id").agg(F.expr("min(event_id) + (max(event_id) - min(event_id)) / 2").alias("_middle"))
    goes = F.when(F.col("event_id") <= F.col("_middle"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(True)))
    landing = rows.join(middle, ["instance_id", "thread_id"]).withColumn("_again", F.explode(goes)).drop("_middle")
    _in_landings(t, "tail-landing", landing, F.col("_again"),
                 lambda stream: streaming.stream_tail(stream.drop("_again"), tail, checkpoint, once=True))
    return tail.events(t.spark, rows.schema).select("instance_id", "thread_id", "event_id")


@query
def stream_to_lake(t: Telemetry) -> DataFrame:
    base, checkpoint = run_dir(t.spark, "stream-lake"), run_dir(t.spark, "lake-checkpoint")
    _in_landings(t, "landing", t.metrics(), F.col("metric_name") > "innodb", lambda stream: streaming.stream_to_lake(
        stream, streaming.LakeStream(base, "metrics", checkpoint, once=True)))
    return sources.read_lake(t.spark, base, "metrics").drop("date")


@query
def stream_findings(t: Telemetry) -> DataFrame:
    """Half of the variables of every snapshot land late."""
    rows = _timed(t.global_variables().withColumn("timestamp", F.lit(CYCLE_TIME)))
    found = streaming.StreamedFindings(run_dir(t.spark, "findings"), parts=8)
    checkpoint = run_dir(t.spark, "findings-checkpoint")
    _in_landings(t, "variables", rows, F.xxhash64("variable_name") % 2 == 0,
                 lambda stream: streaming.stream_findings(stream, found, checkpoint, once=True))
    return found.findings(t.spark, rows.schema).select(*_rule_columns())


@query
def counter_rate_stream(t: Telemetry) -> DataFrame:
    """Digest snapshots in two landings: in the second are snapshots before, between and after those of the first."""
    keys = ("instance_id", "schema_name", "digest")
    rows = t.query_digests().select(*keys, "timestamp", "exec_count")
    steps = streaming.CounterSteps(keys, ("exec_count",), run_dir(t.spark, "steps"), parts=8, period=4)
    checkpoint = run_dir(t.spark, "steps-checkpoint")
    _in_landings(t, "counters", rows, F.crc32(F.col("timestamp").cast("binary")) % 2 == 0,
                 lambda stream: streaming.stream_counter_steps(stream, steps, checkpoint, once=True))
    return steps.steps(t.spark, rows.schema)


# --- additions -------------------------------------------------------------

@query
def schema_drift(t: Telemetry) -> DataFrame:
    """Columns and indexes against a later state: nullable columns gone, unique indexes changed."""
    columns, indexes = sources.column_catalog(t.column_rows()), sources.index_catalog(t.index_rows())
    tables = sources.table_catalog(t.table_rows())
    later_columns = sources.column_catalog(t.column_rows().filter("is_nullable = 'NO'"))
    later_indexes = sources.index_catalog(t.index_rows().withColumn("index_type", F.when(
        F.col("non_unique") == 0, F.lit("HASH")).otherwise(F.col("index_type"))))
    drift = op.schema_drift(op.assemble_schemas(tables, columns, indexes),
                            op.assemble_schemas(tables, later_columns, later_indexes))
    return drift.select("instance_id", "schema_name", "table_name", "kind", "name", "change")
