"""What must not grow with the tables: rows of a task, and how often rows are shuffled or computed."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetgauge import envelopes, payloads, run_dir, statement_tail
from fleetgauge.functions import instant
from fleetgauge.plans import queries, telemetry
from fleetgauge.streaming import CellTable, CounterSteps, StreamedFindings, WaitSummaries


def test_customers_in_tasks_of_bounded_size(spark, tmp_path):
    spark.range(200_000).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    rows = telemetry.Telemetry(spark, str(tmp_path))._customers()
    largest = rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest < 2 * 10_000 and rows.count() == 200_000


def test_tail_of_a_hot_instance_takes_many_tasks(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(1, 1_200_001).select(F.lit("hot").alias("instance_id"), F.col("id").alias("event_id"))
        rows = rows.unionByName(spark.createDataFrame([(None, 5), ("new", 7)], "instance_id string, event_id long"))
        tail = statement_tail(rows, spark.createDataFrame([("hot", 1000), ("idle", 3)], "instance_id string, high_water_mark long"))
        tasks = tail.groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in tasks) == 1_199_002 and max(r["count"] for r in tasks) < 600_000
        assert sorted(r.event_id for r in tail.filter("coalesce(instance_id, '') != 'hot'").collect()) == [5, 7]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.fixture
def shuffles(monkeypatch):
    """Shuffles of every frame that replaces cells, by the last part of the table's path; cached ones count at their first use."""
    seen, replace = {}, CellTable.replace

    def spy(self, batch, rows, *more, **options):
        plan = rows._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
        seen.setdefault(self.path.rsplit("/", 1)[1], []).append(len(re.findall(r"Exchange (?:hash|rebalance|round)", plan)))
        replace(self, batch, rows, *more, **options)
    monkeypatch.setattr(CellTable, "replace", spy)
    return seen


def test_findings_are_dealt_out_once_per_table(spark, shuffles):
    rows = spark.createDataFrame([("a", "read_only", "OFF", "2026-04-24 10:00:00"), ("a", "port", "1", "2026-04-24 10:00:00")],
                                 "instance_id string, variable_name string, variable_value string, timestamp string")
    found = StreamedFindings(run_dir(spark, "findings"), parts=2)
    found(rows.withColumn("event_time", instant(F.col("timestamp"))), 0)
    assert shuffles == {"variables": [1], "findings": [1]}


def test_steps_are_dealt_out_once(spark, shuffles):
    steps = CounterSteps(("k",), ("n",), run_dir(spark, "steps"), parts=2)
    for batch, rows in enumerate(([("x", "2026-04-24 10:00:00", 5)], [("x", "2026-04-24 09:00:00", 2), ("x", "2026-04-24 10:00:00", 6)])):
        frame = spark.createDataFrame(rows, "k string, timestamp string, n long")
        steps(frame, batch)
    assert shuffles["snapshots"] == [1, 1]
    assert [(r.timestamp, r.n_increase) for r in steps.steps(spark, frame.schema).collect()] == [("2026-04-24 10:00:00", 4)]


def test_digests_are_shuffled_once(spark):
    plan = telemetry.Telemetry(spark, "/root/testdata/sf0.001").query_digests()._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hash", plan)) == 1


def test_landings_are_computed_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "run_dir", lambda _, purpose: f"{tmp_path}/{purpose}")
    computed, counts = spark.sparkContext.accumulator(0), []

    def begin(stream):
        at = len(counts)
        counts.append(0)

        def keep(batch, _):
            counts[at] += batch.count()
        return stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()

    count = F.udf(lambda n: computed.add(1) or n, "long")
    rows = spark.range(40).select(count.asNondeterministic()("id").alias("id"))
    queries._in_landings(telemetry.Telemetry(spark, ""), "landing", rows, F.col("id") % 4 == 0, begin)
    assert counts == [30, 10] and computed.value == 40


def test_tables_are_dealt_out_once_for_columns_and_once_for_indexes(spark, tmp_path):
    lines = [(1, n, 10 + n, "A", "O") for n in (1, 2)] + [(2, 1, 12, "R", "F")]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string, l_linestatus string").write.parquet(
        f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 3, "O", 5.0), (2, 4, "O", 6.0)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(
        f"{tmp_path}/orders.parquet")
    documents = queries._documents(telemetry.Telemetry(spark, str(tmp_path)))
    plan = documents._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hash", plan)) <= 3  # columns, indexes and, unless it is broadcast, tables
    assert {r.table_name: (len(r.columns), len(r.indexes)) for r in documents.collect()} == {"t1": (2, 2), "t2": (1, 1)}


def test_messages_of_a_large_instance_take_many_tasks(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        instances = spark.createDataFrame([("hot", "c"), ("hot", "d"), ("small", "c"), (None, "c")], "instance_id string, cluster_id string")
        rows = spark.range(20_000).select(F.lit("hot").alias("instance_id"), F.concat(F.lit("t"), "id").alias("table_name"))
        rows = rows.unionByName(spark.createDataFrame([("small", "t"), ("unknown", "t"), (None, "t")], "instance_id string, table_name string"))
        made = payloads(instances, schemas=rows)
        plain = envelopes(instances, made, "t", seed="x")
        spread = envelopes(instances, made, "t", seed="x", hot=spark.createDataFrame([("hot",)], "instance_id string"))
        assert Counter(spread.collect()) == Counter(plain.collect()) and spread.count() == 40_001
        assert spread.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 30_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_index_messages_of_a_large_instance_are_made_once_in_many_tasks(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        instances = spark.createDataFrame([("hot", "c"), ("hot", "d"), ("small", "c"), ("none", "c"), (None, "c")], "instance_id string, cluster_id string")
        computed = spark.sparkContext.accumulator(0)
        count = F.udf(lambda name: computed.add(1) or name, "string").asNondeterministic()
        tables = spark.range(2000).select(F.lit("hot").alias("instance_id"), F.concat(F.lit("t"), "id").alias("table"))
        tables = tables.unionByName(spark.createDataFrame([("small", "t"), ("unknown", "t"), (None, "t")], "instance_id string, `table` string"))
        duplicates = tables.select(
            "instance_id", F.lit("s").alias("database"), count("table").alias("table"), F.lit("k").alias("duplicate_index"), F.lit("l").alias("overlaps_with"),
            F.array(F.lit("x")).alias("columns"), F.lit("drop").alias("drop_statement"))
        hot = spark.createDataFrame([("hot",)], "instance_id string")
        made = payloads(instances, duplicates=duplicates, hot=hot)["pt-duplicate-key-checker"]
        rows = made.select("instance_id", "json_payload", F.spark_partition_id().alias("task")).collect()
        assert computed.value == 2003  # the findings are not computed again for instances without any
        assert max(Counter(r.task for r in rows).values()) < 2000  # 4000 in one task before
        assert Counter(r.instance_id for r in rows) == {"hot": 4000, "small": 1, "none": 1, None: 1}
        assert [r.json_payload for r in rows if r.instance_id in ("none", None)] == ['{"findings":null}'] * 2
        plain = payloads(instances, duplicates=duplicates)["pt-duplicate-key-checker"]
        assert Counter(plain.collect()) == Counter((r.instance_id, r.json_payload) for r in rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_waits_are_dealt_out_once(spark, shuffles):
    batch = spark.createDataFrame(
        [("i", "c", 9, "io", 5, "2026-04-24 10:00:01", True, None, None), ("i", None, None, None, None, "2026-04-24 10:00:02", False, 9, "A")],
        "instance_id string, cluster_id string, nesting_event_id long, event_name string, timer_wait long, at string, _wait boolean, event_id long, digest string")
    WaitSummaries(run_dir(spark, "waits"), parts=2)(batch.withColumn("event_time", instant(F.col("at"))), 0)
    assert shuffles == {"waits": [0], "statements": [0]}  # both are cut from rows that were dealt out before
