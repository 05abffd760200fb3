"""Connected components by alternating large and small stars, on staged tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, staged


def _star(links: DataFrame, small: bool) -> DataFrame:
    """Hangs the neighbours of each node on the least of them: those above the node (large), or it and those below (small)."""
    if small:
        around = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        around = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hung = around.join(least, "u")
    if small:
        moved = hung.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        moved = hung.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.filter("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b); a component is named by its least node.

    Nodes of a component end as a star around it, after a number of turns that grows with the logarithm of its size. Every
    turn is written to the shared folder. Links to itself and repeated links do no harm; no links give no rows.
    """
    now = staged(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct(), "links")
    state = None
    while True:
        after = staged(_star(_star(now, small=False), small=True), "links")
        sums = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        forget(now)
        now = after
        if sums == state:
            break
        state = sums
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(now.select("b", "b").distinct())
