"""Wait events and the statements they belong to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import five_second_bucket, or_empty
from ..schemas import COUNTER
from .skew import spread_join
from .snapshots import latest_per_instance

INSTANCE = ("instance_id",)
SUMMARY_KEYS = ("instance_id", "cluster_id", "parent_digest", "event_name")


def _parents(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One digest per (keys, nesting_event_id); of a repeated event the newest row counts."""
    order = ["timestamp"] if "timestamp" in samples.columns else []
    newest = F.max(F.struct(*order, or_empty(F.col("digest")).alias("digest")))
    return samples.groupBy(*keys, F.col("event_id").alias("nesting_event_id")).agg(
        newest["digest"].alias("parent_digest"))


def correlate_waits(
    waits: DataFrame, samples: DataFrame, keys: Sequence[str] = INSTANCE, hot: DataFrame | None = None
) -> DataFrame:
    """Every wait with the digest of its statement, '' when that was not captured.

    Waits outside any statement (nesting id 0) have no partner, since event ids
    start at 1; they and the waits of very long statements are spread over tasks.
    """
    joined = spread_join(
        waits, _parents(samples, keys), [*keys, "nesting_event_id"], F.struct("event_id", "timer_start"),
        hot=hot, unmatched=F.coalesce(F.col("nesting_event_id") == 0, F.lit(True)),
    )
    return joined.withColumn("parent_digest", or_empty(F.col("parent_digest")))


def aggregate_waits(correlated: DataFrame) -> DataFrame:
    """Count and total wait by statement, event and five-second bucket of the collection time."""
    bucketed = correlated.withColumn("timestamp", five_second_bucket(F.col("timestamp")))
    return bucketed.groupBy(*SUMMARY_KEYS, "timestamp").agg(
        F.count("*").cast(COUNTER).alias("count"), F.sum("timer_wait").cast(COUNTER).alias("total_wait"),
    ).select(*SUMMARY_KEYS, "count", "total_wait", "timestamp")


def wait_summary(
    waits: DataFrame, samples: DataFrame, keys: Sequence[str] = INSTANCE, digest: str | None = None
) -> DataFrame:
    """`aggregate_waits(correlate_waits(...))` with the sums taken before the join.

    Counts and sums can be merged, so the waits of one statement shrink to a row
    per event and bucket first. Neither a statement with a huge number of waits
    nor the waits without one reach the join row by row. With `digest`, only the
    statements of that digest are joined, and only their waits are kept.
    """
    bucketed = waits.withColumn("timestamp", five_second_bucket(F.col("timestamp")))
    by_parent = bucketed.groupBy(
        *dict.fromkeys([*keys, "instance_id", "cluster_id"]), "nesting_event_id", "event_name", "timestamp",
    ).agg(F.count("*").alias("_count"), F.sum("timer_wait").alias("_wait"))
    parents = _parents(samples, keys)
    if not digest:  # waits without a statement have the digest ''
        tagged = by_parent.join(parents, [*keys, "nesting_event_id"], "left")
    else:
        tagged = by_parent.join(parents.filter(F.col("parent_digest") == digest), [*keys, "nesting_event_id"])
    tagged = tagged.withColumn("parent_digest", or_empty(F.col("parent_digest")))
    return tagged.groupBy(*SUMMARY_KEYS, "timestamp").agg(
        F.sum("_count").cast(COUNTER).alias("count"), F.sum("_wait").cast(COUNTER).alias("total_wait"),
    ).select(*SUMMARY_KEYS, "count", "total_wait", "timestamp")


def sample_digests(samples: DataFrame, digests: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Samples with the text and counters of their digest in its instance's newest snapshot.

    A digest that was run in several schemas is summed, so no sample is repeated.
    One digest may well cover most samples of a fleet: its rows are spread, and so are samples without a digest.
    """
    current = latest_per_instance(digests).groupBy("instance_id", "digest").agg(
        F.max("digest_text").alias("digest_text"), F.sum("exec_count").alias("exec_count"),
        F.sum("sum_timer_wait").alias("sum_timer_wait"),
    )
    return spread_join(samples, current, ["instance_id", "digest"], F.col("event_id"), hot=hot, unmatched=F.col("digest").isNull())
