"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 1000  # upper bound of the broadcast key list
HOT_GROUP = 1_000_000
SLICES = 64


def hot_keys(rows: DataFrame, keys: Sequence[str], fraction: float = 0.01, at_least: int = 10_000) -> DataFrame:
    """The heaviest keys, found in a sample that reads the key columns only.

    The list steers placement, never the result: a key that is missing from it
    is joined in one slice. That is why it may be cut at HOT_KEYS rows, which in
    turn is what makes it safe to broadcast.
    """
    seen = rows.select(*keys).sample(fraction=fraction, seed=17) if fraction < 1 else rows.select(*keys)
    counted = seen.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= at_least)
    return counted.orderBy(F.desc("_n")).limit(HOT_KEYS).select(*keys)


def cut_points(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], fraction: float = 0.01, every: int = 100
) -> DataFrame:
    """(*keys, cuts): places in a key's rows as `order` sorts them, about `every / fraction` rows apart, for keys with so many.

    They come from a sample that reads these columns only, and steer how rows are divided, never which.
    """
    seen = rows.select(*keys, *order)
    seen = seen.sample(fraction=fraction, seed=17) if fraction < 1 else seen
    places = seen.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order))).alias("_places"))
    cuts = F.filter("_places", lambda _, at: at % every == every - 1)
    return places.select(*keys, cuts.alias("cuts")).filter("size(cuts) > 0")


def with_group(rows: DataFrame, keys: Sequence[str], spread_by: Column, **totals: Column) -> DataFrame:
    """Rows with aggregates of their group beside them.

    A window would bring a whole group into one task. Here the aggregates are
    combined before the shuffle and joined back; their counts tell exactly
    which groups are so large that their rows have to be spread.
    """
    groups = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *(total.alias(name) for name, total in totals.items()))
    hot = groups.filter(F.col("_n") >= HOT_GROUP).orderBy(F.desc("_n")).limit(HOT_KEYS).select(*keys)
    return spread_join(rows, groups.drop("_n"), keys, spread_by, hot=hot)


def spread(
    rows: DataFrame, lookup: DataFrame, keys: Sequence[str], spread_by: Column, hot: DataFrame, unmatched: Column | None = None,
    slices: int = SLICES,
) -> tuple[DataFrame, DataFrame]:
    """`rows` and `lookup` with a `_slice` to join on beside `keys`; see `spread_join`."""
    marked = F.broadcast(hot.select(*keys, F.lit(True).alias("_hot")))
    is_hot = F.coalesce("_hot", F.lit(False))
    if unmatched is not None:
        is_hot = is_hot | unmatched
    piece = F.pmod(F.xxhash64(spread_by), F.lit(slices)).cast("int")
    left = rows.join(marked, list(keys), "left").withColumn("_slice", F.when(is_hot, piece).otherwise(F.lit(0)))
    pieces = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(slices - 1))).otherwise(F.array(F.lit(0)))
    right = lookup.join(marked, list(keys), "left").withColumn("_slice", F.explode(pieces))
    return left.drop("_hot"), right.drop("_hot")


def spread_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread_by: Column,
    hot: DataFrame | None = None,
    unmatched: Column | None = None,
    slices: int = SLICES,
) -> DataFrame:
    """`rows LEFT JOIN lookup USING (keys)`, the rows of hot keys spread over `slices` tasks.

    `lookup` holds a key once; only its hot keys are repeated, once per slice.
    `spread_by` must be fixed per row, so that a task that is run again puts its
    rows where they were. Rows for which `unmatched` holds are known to have no
    partner and are spread without repeating anything.
    """
    if hot is None:
        hot = hot_keys(rows, keys)
    left, right = spread(rows, lookup, keys, spread_by, hot, unmatched, slices)
    return left.join(right, [*keys, "_slice"], "left").drop("_slice")
