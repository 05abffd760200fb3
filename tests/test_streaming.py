"""Streams against the batch operators, over landings that come late and out of order."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from fleetgauge import check_variables, counter_increase, read_lake, run_dir, wait_summary
from fleetgauge.functions import instant
from fleetgauge.schemas import METRICS
from fleetgauge.streaming import (
    CellTable, CounterSteps, EventTail, LakeStream, StreamedFindings, WaitSummaries, stream_counter_steps, stream_findings, stream_tail,
    stream_to_lake, stream_wait_summary,
)
from fleetgauge.streaming.cells import LISTED


class Landing:
    """A folder that receives rows, read as a stream; each land() is one file."""

    def __init__(self, spark, schema):
        self.spark, self.path = spark, run_dir(spark, "landing")
        self.given = schema + ", timestamp string"
        self.schema = self.frame([]).schema

    def frame(self, rows):
        return self.spark.createDataFrame(rows, self.given).withColumn("event_time", instant(F.col("timestamp")))

    def land(self, rows):
        self.frame(rows).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.schema).parquet(self.path)

    def batch(self):
        return self.spark.read.schema(self.schema).parquet(self.path)


WAITS = "instance_id string, cluster_id string, event_id long, nesting_event_id long, event_name string, timer_wait long"
SAMPLES = "instance_id string, event_id long, digest string"


def summed(rows):
    return {(r.instance_id, r.parent_digest, r.event_name, r.timestamp): (int(r["count"]), int(r.total_wait)) for r in rows.collect()}


def test_waits_at_any_distance_from_their_statement(spark):
    waits, samples = Landing(spark, WAITS), Landing(spark, SAMPLES)
    summaries, checkpoint = WaitSummaries(run_dir(spark, "summary"), parts=2, span=150), run_dir(spark, "checkpoint")
    day = "2026-04-24 "
    landings = [
        ([("i", "c", 1, 100, "io", 5, day + "10:00:01"), ("i", "c", 2, 100, "io", 7, day + "11:30:04"), ("i", "c", 3, 0, "io", 11, day + "10:00:02"),
          ("i", "c", 4, 999, "io", 13, day + "10:00:06"), ("i", "c", 5, None, "io", 1, day + "10:00:06")], [("i", 200, "B", day + "10:00:30")]),
        # The statement of the first waits, an hour and more away from them, twice; and waits of one that is known, a day before it.
        ([("i", "c", 6, 200, "lock", 17, "2026-04-23 10:00:30"), ("j", "c", 7, 100, "io", 1, day + "10:00:01")],
         [("i", 100, "A", day + "09:00:00"), ("i", 100, "A", day + "09:00:00")]),
        # Nothing but a wait; then nothing but statements, one of them known under an older digest and one without any.
        ([("i", "c", 8, 100, "io", 19, day + "10:00:03")], []),
        ([], [("i", 200, "B2", day + "10:00:31"), ("j", 100, None, day + "10:00:00"), ("i", None, "X", day + "10:00:00")]),
        ([("j", "c", 9, 100, "io", 1, day + "10:00:02")], [("i", 200, "old", "2026-04-01 00:00:00")]),
    ]
    for w, s in landings:
        waits.land(w), samples.land(s)
        stream_wait_summary(waits.stream(), samples.stream(), summaries, checkpoint, once=True).awaitTermination()
        assert summed(summaries.summary(spark)) == summed(wait_summary(waits.batch(), samples.batch().filter("event_id IS NOT NULL")))
    got = summed(summaries.summary(spark))
    assert got[("i", "A", "io", day + "10:00:00")] == (2, 24) and got[("i", "A", "io", day + "11:30:00")] == (1, 7)
    assert got[("i", "B2", "lock", "2026-04-23 10:00:30")] == (1, 17) and got[("i", "", "io", day + "10:00:05")] == (2, 14)


def test_a_wait_batch_run_again_counts_once(spark):
    waits, samples = Landing(spark, WAITS), Landing(spark, SAMPLES)
    summaries = WaitSummaries(run_dir(spark, "summary"), parts=2)
    own = [c for c in ("instance_id", "cluster_id", "nesting_event_id", "event_name", "timer_wait", "event_time")]
    both = lambda w, s: waits.frame(w).select(*own, F.lit(True).alias("_wait")).unionByName(
        samples.frame(s).select("instance_id", "event_id", "digest", "event_time", F.lit(False).alias("_wait")), allowMissingColumns=True)
    first, second = both([("i", "c", 1, 9, "io", 5, "2026-04-24 10:00:01")], []), both([], [("i", 9, "A", "2026-04-24 10:00:01")])
    summaries(first, 0), summaries(second, 1), summaries(second, 1)
    assert summed(summaries.summary(spark)) == {("i", "A", "io", "2026-04-24 10:00:00"): (1, 5)}


def test_tail_never_forgets(spark):
    events = Landing(spark, "instance_id string, thread_id long, event_id long, what string")
    tail, checkpoint = EventTail(run_dir(spark, "tail"), parts=3), run_dir(spark, "checkpoint")
    at, hour, day = "2026-04-24 10:00:00", "2026-04-24 11:00:00", "2026-04-25 11:00:00"

    def go(rows):
        before = Counter(tail.events(spark, events.schema).collect()) if goes else Counter()
        events.land(rows)
        goes.append(stream_tail(events.stream(), tail, checkpoint, once=True).awaitTermination())
        return sorted((r.instance_id or "", r.thread_id, r.event_id) for r in (Counter(tail.events(spark, events.schema).collect()) - before).elements())
    goes = []
    first = [("i", 1, n, "a", at) for n in (1, 2)] + [("i", 1, 2, "a", at), ("i", 1, None, "a", at), (None, 1, 1, "a", at)]
    assert go(first) == [("", 1, 1), ("i", 1, 1), ("i", 1, 2)]
    assert go([("i", 1, 2, "a", hour), ("i", 1, 1, "a", hour)]) == []                     # the same again an hour later
    assert go([("i", 1, 2, "a", day), ("i", 2, 2, "b", at), ("i", 1, 3, "a", day), ("j", 1, 1, "c", at)]) == [("i", 1, 3), ("i", 2, 2), ("j", 1, 1)]
    assert go(first + [("i", 1, 7, "z", at), ("i", 1, 5, "y", at)]) == [("i", 1, 5), ("i", 1, 7)]
    batch = events.frame([("i", 1, 8, "q", at)])
    for _ in range(2):
        tail(batch, 4)
    assert sum(r.event_id == 8 for r in tail.events(spark, events.schema).collect()) == 1


def test_lake_writer_continues(spark):
    path, base, checkpoint = run_dir(spark, "in"), run_dir(spark, "lake"), run_dir(spark, "checkpoint")
    for n in range(2):
        spark.createDataFrame([(f"{i}", "c", "m", float(n), "2026-04-24 10:00:00") for i in (7, 8)], METRICS).write.mode("append").parquet(path)
        for _ in range(2):  # the second run finds nothing new
            stream_to_lake(spark.readStream.schema(METRICS).parquet(path), LakeStream(base, "metrics", checkpoint, once=True)).awaitTermination()
        assert read_lake(spark, base, "metrics").count() == 2 * (n + 1)
    assert {r.instance_id for r in read_lake(spark, base, "metrics").collect()} == {"7", "8"}
    assert read_lake(spark, base, "metrics").columns == [*METRICS.names, "date"]
    assert read_lake(spark, base, "metrics", instance="7").count() == 2


def test_a_hot_instance_is_written_by_many_tasks_and_a_repeated_batch_once(spark):
    base = run_dir(spark, "lake")
    sink = LakeStream(base, "metrics", "unused")
    hot = spark.range(60000).select(
        F.when(F.col("id") % 20 > 0, "hot").otherwise(F.concat(F.lit("i"), F.col("id") % 3)).alias("instance_id"), F.lit("c").alias("cluster_id"),
        F.concat(F.lit("metric"), F.sha2(F.col("id").cast("string"), 256)).alias("metric_name"), F.rand(1).alias("value"), F.lit("2026-04-24 10:00:00").alias("timestamp"))
    kept = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        for _ in range(2):
            sink(hot, 0)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", kept)
    rows = read_lake(spark, base, "metrics")
    assert rows.count() == 60000
    assert rows.filter("instance_id = 'hot'").select(F.input_file_name()).distinct().count() > 4
    assert rows.filter("instance_id = 'i0'").select(F.input_file_name()).distinct().count() == 1


def test_findings_of_late_variables(spark):
    variables = Landing(spark, "instance_id string, variable_name string, variable_value string")
    found, checkpoint = StreamedFindings(run_dir(spark, "findings"), parts=2), run_dir(spark, "checkpoint")
    at, later = "2026-04-24 10:00:00", "2026-04-24 12:00:00"
    rows = [("a", "log_bin", "ON", at), ("a", "innodb_flush_method", "fsync", at), ("a", "aurora_version", "", at),
            ("a", "sync_binlog", "0", at), ("a", "expire_logs_days", "0", at)]

    def go(landed):
        variables.land(landed)
        stream_findings(variables.stream(), found, checkpoint, once=True).awaitTermination()
        got = {(r.instance_id, str(r.event_time), r.rule_id, r.severity) for r in found.findings(spark, variables.schema).collect()}
        batch = check_variables(variables.batch(), keys=("instance_id", "event_time"))
        assert got == {(r.instance_id, str(r.event_time), r.rule_id, r.severity) for r in batch.collect()}
        return {(i, rule) for i, _, rule, _ in got}
    # Of half a snapshot a rule that the other half silences may speak; two hours of newer rows do not settle it.
    assert ("a", "innodb_flush_method") in go(rows[:2])
    go([("b", "version", "", later), ("a", "innodb_flush_method", "O_DIRECT", later)])
    assert {rule for i, rule in go(rows[2:]) if i == "a"} == {"expire_logs_days"}
    go([("b", "version", "8.0.35", later), ("b", "version", "8.0.35", later), (None, "log_bin", "OFF", at), ("n", "log_bin", "OFF", None)])
    batch = variables.frame(rows)
    for _ in range(2):
        found(batch, 9)
    assert sum(r.rule_id == "expire_logs_days" for r in found.findings(spark, variables.schema).collect()) == 1


KIND = "k string, timestamp string, n long, m long"


def stepped(frame):
    return Counter((r.k, r.timestamp, r.n_increase, r.m_increase) for r in frame.collect())


def test_counter_steps_over_landings_out_of_order(spark):
    path, checkpoint = run_dir(spark, "in"), run_dir(spark, "checkpoint")
    steps = CounterSteps(("k",), ("n", "m"), run_dir(spark, "steps"), parts=2, period=10)
    rng = random.Random(4)
    rows = [(k, f"2026-04-{d:02d} {h:02d}:00:00", rng.randrange(50), rng.randrange(50)) for k in ("a", "b", "c", None)
            for d in range(1, 9) for h in (0, 9, 23) if rng.random() < 0.6]
    first, second, third, fourth = ([r for r in rows if r[1][8:10] in days] for days in (("01", "02"), ("03", "04"), ("05", "06"), ("07", "08")))
    first.append(("once", "2026-04-01 00:00:00", 1, 1))
    schema = spark.createDataFrame([], KIND).schema
    for landing in (first, third, second[::2], fourth, second[1::2] + [("d", "2026-04-05 00:00:00", 3, 3), ("d", None, 1, 1)]):
        spark.createDataFrame(landing, KIND).coalesce(1).write.mode("append").parquet(path)
        stream_counter_steps(spark.readStream.schema(schema).parquet(path), steps, checkpoint, once=True).awaitTermination()
        landed = spark.read.schema(schema).parquet(path).filter("timestamp IS NOT NULL")
        batch = counter_increase(landed, ["k"], ["n", "m"]).filter("n_increase IS NOT NULL")
        assert stepped(steps.steps(spark, schema)) == stepped(batch)


def test_counter_batches_touch_what_they_must(spark):
    steps = CounterSteps(("k",), ("n",), run_dir(spark, "steps"), parts=4, period=10)
    snapshots = CellTable(f"{steps.path}/snapshots")
    day = lambda d, k, n: (k, f"2026-04-{d:02d} 10:00:00", n, 0)
    frame = lambda *rows: spark.createDataFrame(list(rows), KIND)
    result = lambda: {(r.k, r.timestamp[8:10], r.n_increase) for r in steps.steps(spark, frame().schema).collect()}
    keys = [f"key {i}" for i in range(12)]
    steps(frame(*(day(d, k, d * d) for d in (1, 4, 5) for k in keys)), 0)
    before = set(snapshots.files(spark))
    steps(frame(day(2, keys[0], 10)), 1)
    after = set(snapshots.files(spark))
    # The cell of the new day, and the one of the day that now steps from it; all others keep their files.
    assert len(after - before) == 2 and len(before - after) == 1 and {f.split("~")[1] for f in after - before} == {"2026-04-02", "2026-04-04"}
    assert {x for x in result() if x[0] == keys[0]} == {(keys[0], "02", 9), (keys[0], "04", 6), (keys[0], "05", 9)}
    assert {x for x in result() if x[0] == keys[1]} == {(keys[1], "04", 15), (keys[1], "05", 9)}
    # A batch that is run again reads what was there before its first try.
    for _ in range(2):
        steps(frame(day(3, keys[1], 13), day(6, keys[1], 4)), 2)
    assert {x for x in result() if x[0] == keys[1]} == {(keys[1], "03", 12), (keys[1], "04", 3), (keys[1], "05", 9), (keys[1], "06", 4)}
    # A snapshot that comes again with other values replaces the one that was there, also as the end of a day.
    steps(frame(day(3, keys[1], 1)), 3)
    assert {x for x in result() if x[0] == keys[1]} == {(keys[1], "03", 0), (keys[1], "04", 15), (keys[1], "05", 9), (keys[1], "06", 4)}


def test_cells_are_replaced_and_old_files_go(spark):
    table = CellTable(run_dir(spark, "cells"))
    schema = spark.createDataFrame([], "x int").schema
    rows = lambda **cells: spark.createDataFrame([(x, c) for c, xs in cells.items() for x in xs], "x int, cell string")
    held = lambda **k: {c: sorted(x) for c, x in _grouped(table.read(spark, schema, **k).collect()).items()}
    assert held() == {}
    table.replace(0, rows(a=[1, 2], b=[3]), ["a", "b"])
    table.replace(1, rows(b=[4], c=[5]), ["b", "c"])
    assert held() == {"a": [1, 2], "b": [4], "c": [5]} and held(cells=["a", "z"]) == {"a": [1, 2]}
    assert held(before=1) == {"a": [1, 2], "b": [3]}
    table.replace(2, rows(), ["c"])
    table.replace(3, rows(a=[6]), ["a"])
    assert held() == {"a": [6], "b": [4]}
    files, root = table._folder(spark, "rows", "batch=0", "cell=b")
    assert not files.exists(root)
    assert spark.read.schema(LISTED).parquet(f"{table.path}/cells/batch=3").count() == 2


def _grouped(rows):
    cells = defaultdict(list)
    for row in rows:
        cells[row.cell].append(row.x)
    return cells


def test_working_folder_without_a_setting_is_in_the_warehouse():
    from fleetgauge import session

    class Session:
        class conf:
            @staticmethod
            def get(key, default=None):
                return {"spark.sql.warehouse.dir": "hdfs:///warehouse"}.get(key, default)
    assert session.shared_dir(Session) == "hdfs:///warehouse/fleetgauge-work"
