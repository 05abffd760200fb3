"""Correlation, five-second sums, history tails, sampling."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetgauge import (
    aggregate_waits, buffer_bounds, buffer_lifespan, correlate_waits, high_water_marks, hot_keys, sample_digests,
    sampling_advice, spread_join, statement_tail, wait_summary, wait_tail,
)

WAITS = ("instance_id string, cluster_id string, event_id long, thread_id long, nesting_event_id long, event_name string, "
         "timer_wait long, timer_start long, timestamp string")
SAMPLES = "instance_id string, event_id long, digest string, timestamp string"
NOW = "2026-04-24 10:00:03"


def test_orphans_and_parents(spark):
    samples = spark.createDataFrame([("i", 100, "A", NOW), ("i", 200, "B", NOW), ("j", 999, "C", NOW)], SAMPLES)
    waits = spark.createDataFrame(
        [("i", "c", n, 1, parent, "wait/io/table", 5, n, NOW) for n, parent in
         ((1001, 100), (1002, 200), (1003, 999), (1004, 0), (1005, None))], WAITS)
    got = {r.event_id: r.parent_digest for r in correlate_waits(waits, samples).collect()}
    assert got == {1001: "A", 1002: "B", 1003: "", 1004: "", 1005: ""}


def test_repeated_event_counts_once(spark):
    samples = spark.createDataFrame(
        [("i", 1, "old", "2026-04-24 10:00:00"), ("i", 1, "new", NOW), ("i", 1, "new", NOW)], SAMPLES)
    waits = spark.createDataFrame([("i", "c", 7, 1, 1, "w", 5, 1, NOW)], WAITS)
    assert [r.parent_digest for r in correlate_waits(waits, samples).collect()] == ["new"]


def test_sums(spark):
    correlated = spark.createDataFrame(
        [("inst-1", "c", d, e, w, NOW) for d, e, w in
         (("d1", "wait/io/table", 100), ("d1", "wait/io/table", 200), ("d1", "wait/lock/row", 50), ("d2", "wait/io/table", 300))],
        "instance_id string, cluster_id string, parent_digest string, event_name string, timer_wait long, timestamp string")
    rows = {(r.parent_digest, r.event_name): (r["count"], r.total_wait, r.timestamp) for r in aggregate_waits(correlated).collect()}
    assert rows == {("d1", "wait/io/table"): (2, 300, "2026-04-24 10:00:00"),
                    ("d1", "wait/lock/row"): (1, 50, "2026-04-24 10:00:00"),
                    ("d2", "wait/io/table"): (1, 300, "2026-04-24 10:00:00")}


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of the waits are outside statements, a quarter belong to one statement."""
    draw = random.Random(5)
    waits = []
    for n in range(4000):
        parent = 0 if n % 2 else 77 if n % 4 == 0 else draw.randrange(1, 400)
        waits.append((f"i{n % 3}", "c", n, n % 9, parent, f"w{n % 5}", draw.randrange(1000), n, f"2026-04-24 10:00:{n % 60:02d}"))
    samples = [(f"i{i}", event, f"d{event % 20}", NOW) for i in range(3) for event in range(1, 300)]
    return spark.createDataFrame(waits, WAITS), spark.createDataFrame(samples, SAMPLES), waits, samples


def test_hot_parents_are_spread_and_nothing_changes(spark, skewed):
    waits, samples, raw, listed = skewed
    hot = hot_keys(waits, ["instance_id", "nesting_event_id"], fraction=1.0, at_least=300)
    assert {r.nesting_event_id for r in hot.collect()} == {0, 77}
    digest = {(i, e): d for i, e, d, _ in listed}
    expected = Counter((w[2], digest.get((w[0], w[4]), "")) for w in raw)
    for given in (hot, None):
        got = correlate_waits(waits, samples, hot=given)
        assert Counter((r.event_id, r.parent_digest) for r in got.collect()) == expected


def test_spread_rows_reach_many_tasks(spark, skewed):
    waits, samples, _, _ = skewed
    lookup = samples.select("instance_id", F.col("event_id").alias("nesting_event_id"), "digest")
    hot = spark.createDataFrame([("i0", 77), ("i1", 77), ("i2", 77)], "instance_id string, nesting_event_id long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # tasks are not merged after the shuffle
    try:
        joined = spread_join(waits.hint("merge"), lookup.hint("merge"), ["instance_id", "nesting_event_id"],
                             F.col("event_id"), hot=hot)
        tasks = joined.filter("nesting_event_id = 77 AND instance_id = 'i0'").select(F.spark_partition_id()).distinct().count()
        assert tasks > 4
        assert joined.count() == waits.count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_summary_before_the_join_is_the_same(skewed):
    waits, samples, raw, _ = skewed
    early, late = wait_summary(waits, samples), aggregate_waits(correlate_waits(waits, samples))
    assert early.columns == late.columns
    assert Counter(early.collect()) == Counter(late.collect())
    assert sum(r["count"] for r in early.collect()) == len(raw)
    assert sum(r.total_wait for r in early.collect()) == sum(w[6] for w in raw)


def test_summary_of_one_digest(skewed):
    waits, samples, _, _ = skewed
    whole = wait_summary(waits, samples)
    digests = [r.parent_digest for r in whole.select("parent_digest").distinct().orderBy("parent_digest").limit(3).collect()]
    for digest in digests:
        want = Counter(whole.filter(F.col("parent_digest") == digest).collect())
        assert Counter(wait_summary(waits, samples, digest=digest).filter(F.col("parent_digest") == digest).collect()) == want


def test_sample_digests_keeps_every_sample(spark):
    samples = spark.createDataFrame([("i", 1, "a", NOW), ("i", 2, "b", NOW), ("j", 3, "a", NOW)], SAMPLES)
    digests = spark.createDataFrame(
        [("i", "a", "s1", "A", 5, 50, "t2"), ("i", "a", "s2", "A", 7, 70, "t2"), ("i", "a", "s1", "A", 1, 10, "t1"),
         ("i", "b", "s1", "B", 1, 10, "t1")],
        "instance_id string, digest string, schema_name string, digest_text string, exec_count long, sum_timer_wait long, timestamp string")
    got = {r.event_id: (r.digest_text, r.exec_count, r.sum_timer_wait) for r in sample_digests(samples, digests).collect()}
    assert got == {1: ("A", 12, 120), 2: (None, None, None), 3: (None, None, None)}


def test_tail_and_marks(spark):
    raw = spark.createDataFrame(
        [("i", 5, None, "q", None, None), ("i", 6, "d", None, 3, "s"), ("j", 1, "d", "q", 1, None)],
        "instance_id string, event_id long, digest string, sql_text string, timer_wait long, current_schema string"
    ).withColumns({name: F.col(name).cast("decimal(20,0)") for name in ("event_id", "timer_wait")})
    marks = spark.createDataFrame([("i", 5), ("k", 9)], "instance_id string, high_water_mark long")
    new = statement_tail(raw, marks)
    assert {(r.instance_id, int(r.event_id), r.digest, r.sql_text, int(r.timer_wait), r.current_schema) for r in new.collect()} == {
        ("i", 6, "d", "", 3, "s"), ("j", 1, "d", "q", 1, "")}
    assert new.schema["timer_wait"].dataType == raw.schema["timer_wait"].dataType
    assert {r.instance_id: int(r.high_water_mark) for r in high_water_marks(new, marks).collect()} == {"i": 6, "j": 1, "k": 9}
    first = statement_tail(raw).filter("instance_id = 'i' AND event_id = 5").first()
    assert (first.digest, int(first.timer_wait), first.current_schema) == ("", 0, "")
    waits = spark.createDataFrame([("i", 5, None, "w", None, None, None, None)],
                                  "instance_id string, event_id long, nesting_event_id long, event_name string, timer_wait long, "
                                  "timer_start long, operation string, source string")
    assert tuple(wait_tail(waits).first()) == ("i", 5, 0, "w", 0, 0, "", "")


def test_bounds_and_advice(spark):
    second = 10**12
    raw = spark.createDataFrame([("i", 10 * second), ("i", 60 * second), ("j", None), ("k", 4 * second)],
                                "instance_id string, timer_start long")
    bounds = buffer_bounds(raw)
    assert {r.instance_id: tuple(r)[1:] for r in bounds.collect()} == {
        "i": (10 * second, 60 * second, 2), "j": (0, 0, 1), "k": (4 * second, 4 * second, 1)}
    assert {r.instance_id: r.lifespan_ns for r in buffer_lifespan(bounds).collect()} == {"i": 50 * 10**9, "j": 0, "k": 0}
    intervals = spark.createDataFrame([("i", 10 * 10**9), ("j", 10 * 10**9)], "instance_id string, interval_ns long")
    assert {r.instance_id: r.next_interval_ns for r in sampling_advice(bounds, intervals).collect()} == {
        "i": 15 * 10**9, "j": 10 * 10**9}
