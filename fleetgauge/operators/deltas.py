"""Growth of cumulative counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import picos_to_seconds, prefix


def _grown(name: str):
    return F.max(name) - F.min(name)


def counter_delta(digests: DataFrame, since: str, limit: int = 20) -> DataFrame:
    """Executions and wait added since `since` per statement text, most added wait first.

    The documented form: texts of different instances fall into one group.
    """
    grown = digests.filter(F.col("timestamp") >= since).groupBy("digest_text").agg(
        _grown("exec_count").alias("new_execs"), picos_to_seconds(_grown("sum_timer_wait")).alias("added_wait_sec"))
    added = grown.filter("new_execs > 0").orderBy(F.desc("added_wait_sec"), "digest_text").limit(limit)
    return added.select(prefix(F.col("digest_text"), 70).alias("query"), "new_execs", "added_wait_sec")


def counter_delta_fleet(digests: DataFrame, since: str) -> DataFrame:
    """The same per (instance, schema, digest), every statement that grew."""
    keys = ("instance_id", "schema_name", "digest")
    grown = digests.filter(F.col("timestamp") >= since).groupBy(*keys).agg(
        _grown("exec_count").alias("new_execs"), picos_to_seconds(_grown("sum_timer_wait")).alias("added_wait_sec"))
    return grown.filter("new_execs > 0")


def counter_increase(
    rows: DataFrame, keys: Sequence[str], counters: Sequence[str], carry: Sequence[str] = ()
) -> DataFrame:
    """Step from the previous snapshot of the same key; after a restart the new value itself.

    An addition to `counter_delta`: max minus min misreads a counter that began
    again at 0. The window is per counter, with one row per poll.
    """
    before = W.partitionBy(*keys).orderBy("timestamp")

    def step(name: str) -> Column:
        last = F.lag(name).over(before)
        return F.when(F.col(name) >= last, F.col(name) - last).when(last.isNotNull(), F.col(name))
    return rows.select(*keys, "timestamp", *carry, *(step(name).alias(f"{name}_increase") for name in counters))
