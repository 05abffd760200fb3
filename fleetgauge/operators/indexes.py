"""Indexes whose columns are the left part of another index of the same table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import drop_index_ddl
from ..sources.catalogs import told_apart


def duplicate_indexes(
    indexes: DataFrame, keys: Sequence[str] = ("instance_id",), keep_one: bool = False
) -> DataFrame:
    """Redundant indexes from an `index_catalog` frame, each with the first index that covers it.

    Candidates are ordered by (number of columns, name). PRIMARY may cover but is
    never reported; of two indexes over the same columns a unique one is not
    reported in favour of one that is not. Identical indexes report each other;
    with `keep_one` the first of them by name is left out.

    The indexes of a table, at most 65 by the server, come together in one row. That takes no shuffle after
    `index_catalog`, which deals its rows out by table.
    """
    table = [*keys, "table_schema", "table_name"]
    folded = F.transform("columns", lambda name: F.lower(name))
    known = indexes.select(
        *table, "index_name", "columns", (~F.col("non_unique")).alias("is_unique"), folded.alias("_folded"),
        F.size("columns").alias("_width"),
    )
    # Parts before the first one without a column name, mostly all.
    unnamed = F.array_position(F.transform("_folded", lambda name: name.isNull()), F.lit(True)).cast("int")
    whole = ~F.exists("_folded", lambda name: name.isNull())
    known = known.withColumn("_usable", F.when(whole, F.col("_width")).otherwise(unnamed - 1)).filter("_usable > 0")
    together = known.groupBy(*told_apart(*table)).agg(F.array_sort(F.collect_list(
        F.struct("_width", "index_name", "is_unique", "_usable", "_folded", "columns"))).alias("_all"))

    def covers(other: Column, index: Column) -> Column:
        fits = (other["_usable"] >= index["_width"]) & (F.slice(other["_folded"], F.lit(1), index["_width"]) == index["_folded"])
        weaker = (other["_width"] == index["_width"]) & index["is_unique"] & ~other["is_unique"]
        return (other["index_name"] != index["index_name"]) & fits & ~weaker

    # Candidates stand in their order, so the first that covers is the one to report.
    pairs = F.transform("_all", lambda index: F.struct(
        index["index_name"].alias("index_name"), index["columns"].alias("columns"), index["is_unique"].alias("is_unique"),
        (index["_usable"] == index["_width"]).alias("_whole"), F.get(F.filter("_all", lambda other: covers(other, index)), F.lit(0)).alias("_cover")))
    found = together.select(*table, F.inline(pairs)).filter(
        (F.upper("index_name") != "PRIMARY") & F.col("_whole") & F.col("_cover").isNotNull())
    if keep_one:
        twin = ((F.col("_cover._width") == F.size("columns")) & (F.col("_cover.is_unique") == F.col("is_unique"))
                & (F.col("index_name") < F.col("_cover.index_name")))
        found = found.filter(~twin)
    return found.select(
        *keys, F.col("table_schema").alias("database"), F.col("table_name").alias("table"),
        F.col("index_name").alias("duplicate_index"), F.col("_cover.index_name").alias("overlaps_with"), "columns",
        drop_index_ddl(F.col("table_schema"), F.col("table_name"), F.col("index_name")).alias("drop_statement"),
        "is_unique",
    )
