"""Poll outcomes over time: failure streaks, clusters that are down, empty polls.

Streaks need the order of an instance's whole history. To keep a long history
from becoming one window, it is cut into days: inside a day a window is short
(a poll takes at least ten seconds, so at most 8640 rows), and only one summary
row per day goes through the window that connects the days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import instant


def _streaks(log: DataFrame, keys: Sequence[str], bad: Column) -> DataFrame:
    """Adds `_run`, the number of bad rows up to and including this one without a break, and
    `_began`, the time of the first of them (NULL on a good row). `ts` is a text timestamp."""
    day = [*keys, "_day"]
    rows = log.withColumn("_day", F.substring("ts", 1, 10)).withColumn("_bad", F.coalesce(bad, F.lit(False)))
    so_far = W.partitionBy(*day).orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_at", F.row_number().over(W.partitionBy(*day).orderBy("ts")))
    rows = rows.withColumn("_good_at", F.max(F.when(~F.col("_bad"), F.col("_at"))).over(so_far))
    rows = rows.withColumn("_island", F.coalesce("_good_at", F.lit(0)))
    in_island = W.partitionBy(*day, "_island").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_first_bad", F.min(F.when(F.col("_bad"), F.col("ts"))).over(in_island))

    # One row per day: how long its last streak is, when that began, and whether the day had a break.
    last = F.max(F.when(F.col("_bad"), F.struct("_at", "_first_bad")))
    days = rows.groupBy(*day).agg(
        F.count("*").alias("_rows"), F.coalesce(F.max("_good_at"), F.lit(0)).alias("_last_good"), last.alias("_last"))
    days = days.select(
        *day, (F.col("_rows") - F.col("_last_good")).alias("_tail"), (F.col("_last_good") > 0).alias("_broken"),
        F.when(F.col("_rows") > F.col("_last_good"), F.col("_last._first_bad")).alias("_tail_began"))
    order = W.partitionBy(*keys).orderBy("_day")
    days = days.withColumn("_span", F.sum(F.col("_broken").cast("int")).over(
        order.rowsBetween(W.unboundedPreceding, 0)))
    since_break = W.partitionBy(*keys, "_span").orderBy("_day").rowsBetween(W.unboundedPreceding, 0)
    days = days.withColumn("_end_run", F.sum("_tail").over(since_break))
    days = days.withColumn("_end_began", F.min("_tail_began").over(since_break))
    carried = days.select(*day, F.lag("_end_run").over(order).alias("_carry"),
                          F.lag("_end_began").over(order).alias("_carry_began"))

    joined = rows.join(carried, day)
    from_before = F.col("_bad") & F.col("_good_at").isNull() & (F.coalesce("_carry", F.lit(0)) > 0)
    run = F.when(F.col("_bad"), F.col("_at") - F.coalesce("_good_at", F.lit(0))
                 + F.when(from_before, F.col("_carry")).otherwise(F.lit(0))).otherwise(F.lit(0))
    began = F.when(F.col("_bad"), F.when(from_before, F.col("_carry_began")).otherwise(F.col("_first_bad")))
    return joined.select(*log.columns, run.cast("bigint").alias("_run"), began.alias("_began"))


def health_streaks(poll_log: DataFrame, threshold: int = 3) -> DataFrame:
    """Consecutive total failures of every instance after each poll; any success resets them.

    `poll_log` has (instance_id, ts, failed); a poll that failed in part is a success.
    """
    rows = _streaks(poll_log, ["instance_id"], F.col("failed").cast("boolean"))
    return rows.select(
        *poll_log.columns, F.col("_run").alias("consecutive_fails"),
        (F.col("_run") >= threshold).alias("needs_reconnect"))


def all_failing_spans(poll_log: DataFrame, give_up_after: int | None = None) -> DataFrame:
    """Spans in which no instance of a cluster answered, with their length in seconds.

    `give_up_after` seconds flags the spans after which a collector would stop;
    None, the default, never does.
    """
    cycles = poll_log.groupBy("cluster_id", "ts").agg(F.bool_and(F.col("failed").cast("boolean")).alias("down"))
    rows = _streaks(cycles, ["cluster_id"], F.col("down")).filter("down")
    spans = rows.groupBy("cluster_id", F.col("_began").alias("down_since")).agg(
        F.max("ts").alias("last_seen_down"), F.count("*").alias("polls"))
    seconds = F.unix_seconds(instant(F.col("last_seen_down"))) - F.unix_seconds(instant(F.col("down_since")))
    gives_up = F.lit(False) if give_up_after is None else seconds >= give_up_after
    return spans.select("*", seconds.alias("seconds"), gives_up.alias("gives_up"))


def poll_outcome(expected: DataFrame, metrics: DataFrame, digests: DataFrame, usage: DataFrame) -> DataFrame:
    """A poll failed when it brought no metric, no digest and no index row.

    `expected` has (instance_id, timestamp), one row per poll that was due.
    """
    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("instance_id", "timestamp", F.lit(name).alias("_kind"))
    kinds = {"metrics": metrics, "digests": digests, "index_usage": usage}
    found = None
    for name, rows in kinds.items():
        part = counted(rows, name)
        found = part if found is None else found.unionByName(part)
    counts = found.groupBy("instance_id", "timestamp").agg(*(
        F.count_if(F.col("_kind") == name).alias(f"{name}_rows") for name in kinds))
    joined = expected.select("instance_id", "timestamp").join(counts, ["instance_id", "timestamp"], "left")
    filled = joined.na.fill(0, [f"{name}_rows" for name in kinds])
    total = F.col("metrics_rows") + F.col("digests_rows") + F.col("index_usage_rows")
    return filled.withColumn("failed", total == 0)
