"""Column functions, all cases of one function in one frame."""

import math

import pytest
from pyspark.sql import functions as F

from fleetgauge import functions as fn

MAX, MIN = 9223372036854775807, -9223372036854775808


def column(spark, texts, make):
    """make(column name) over the texts, in their order."""
    rows = spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "i int, x string")
    return [row[1] for row in rows.select("i", make("x").alias("y")).orderBy("i").collect()]


def check(spark, cases, make):
    got = column(spark, [case[0] for case in cases], make)
    assert dict(zip([case[0] for case in cases], got)) == dict(cases)


def test_strict_int(spark):
    check(spark, [("500", 500), ("-7", -7), ("+7", 7), ("O_DIRECT", None), ("", None), (None, None), ("10.000000", None),
                  (" 5 ", None), ("5\n", None), ("1e3", None), ("0x10", None), (str(MAX), MAX), (str(MIN), MIN),
                  (str(MAX + 1), None), ("9" * 60, None)], fn.strict_int)


def test_clamped_int(spark):
    check(spark, [("12", 12), (None, 0), ("", 0), ("x", 0), (" 1", 0), ("1.5", 0), (str(MAX + 1), MAX), ("9" * 60, MAX),
                  (str(MIN - 1), MIN), ("-" + "9" * 60, MIN), ("-3", -3)], fn.clamped_int)


def test_floats(spark):
    cases = [("1.5", 1.5), ("1e3", 1000.0), (".5", 0.5), ("5.", 5.0), ("1d", None), ("1.0f", None), (" 1", None),
             ("", None), (None, None), ("1e400", None), ("-1e400", None), ("inf", math.inf), ("-Infinity", -math.inf)]
    check(spark, cases, fn.float_or_null)
    zero = {"1e400": math.inf, "-1e400": -math.inf}
    check(spark, [(text, zero.get(text, value if value is not None else 0.0)) for text, value in cases], fn.float_or_zero)


def test_version(spark):
    raw = ["8.0.35-26+aurora2.10.3.0", "5.7.44-log", "", "garbage", None, "8.0", "10.11.6-MariaDB"]
    parts = [tuple(v)[:3] for v in column(spark, raw, fn.version_of)]
    assert parts == [(8, 0, 35), (5, 7, 44), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0), (10, 11, 6)]


@pytest.mark.parametrize("have, want, holds", [
    ("8.0.35", (8, 0, 35), True), ("8.0.35", (8, 0, 30), True), ("8.0.35", (8, 0, 40), False),
    ("8.0.35", (8, 1, 0), False), ("8.4.0", (8, 0, 35), True), ("9.0.0", (8, 0, 35), True), ("5.7.99", (8, 0, 0), False)])
def test_version_at_least(spark, have, want, holds):
    rows = spark.createDataFrame([(have,)], "x string").select(fn.version_of("x").alias("v"))
    assert rows.select(fn.version_at_least("v", *want)).first()[0] is holds


def test_names(spark):
    check(spark, [("my-cluster.abc123.us-east-1.rds.amazonaws.com", "abc123.us-east-1.rds.amazonaws.com"),
                  ("simple.rds.amazonaws.com", "rds.amazonaws.com"), ("nodots", ""), ("trailing.", ""), ("", "")],
          lambda x: fn.dns_suffix(F.col(x)))
    check(spark, [("a.b.c", "a"), ("nodots", "nodots"), (".hidden.b", ".hidden.b"), ("", "")],
          lambda x: fn.cluster_of_host(F.col(x)))


def test_list_items(spark):
    check(spark, [("a, b ,c", ["a", "b", "c"]), ("", [""]), (" x", ["x"])], fn.list_items)


def test_first_non_empty(spark):
    rows = spark.createDataFrame([("a", "b", "c"), ("", "b", "c"), (None, "", "c"), (None, None, "")],
                                 "a string, b string, c string")
    got = rows.select(fn.first_non_empty(F.col("a"), F.col("b"), F.col("c"))).collect()
    assert [row[0] for row in got] == ["a", "b", "c", ""]


def test_five_second_bucket(spark):
    day = "2026-04-24 10:00:"
    check(spark, [(day + at, day + start) for at, start in
                  [("00", "00"), ("03", "00"), ("04", "00"), ("05", "05"), ("07", "05"), ("59", "55")]] + [(None, None)],
          lambda x: fn.five_second_bucket(F.col(x)))


def test_time_is_utc_in_any_session(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        row = spark.sql("SELECT timestamp_seconds(1710054000) AS t").select(
            fn.utc_text(F.col("t")), fn.five_second_bucket(F.lit("2024-03-10 02:30:07")),
            F.unix_seconds(fn.instant(F.lit("2024-03-10 07:00:00")))).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert tuple(row) == ("2024-03-10 07:00:00", "2024-03-10 02:30:05", 1710054000)


def test_adjusted_interval(spark):
    second = 1_000_000_000
    cases = [(10, 10, 5), (10, 50, 15), (10, 25, 10), (10, 0, 10), (2, 2, 1), (50, 300, 60), (10, 15, 10), (10, 40, 10),
             (90, 100, 45), (100, 300, 100), (0, 5, 1)]
    rows = spark.createDataFrame([(i, c * second, s * second) for i, (c, s, _) in enumerate(cases)], "i int, c long, s long")
    got = rows.orderBy("i").select(fn.adjusted_interval(F.col("c"), F.col("s"))).collect()
    assert [row[0] / second for row in got] == [case[2] for case in cases]


def test_span_nanos(spark):
    cases = [(0, 10**12, 0), (10**12, 0, 0), (5, 5, 0), (9, 5, 0), (10**12, 3 * 10**12 + 1999, 2 * 10**9 + 1)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a long, b long")
    for kind in ("bigint", "decimal(20,0)"):
        got = rows.orderBy("i").select(fn.span_nanos(F.col("a").cast(kind), F.col("b").cast(kind))).collect()
        assert [row[0] for row in got] == [case[2] for case in cases]
