"""Differences between two schema snapshots.

A topic for such messages exists, a definition does not; this one is our own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ITEM = "array<struct<name:string,definition:string>>"


def _listed(items: Column, name: str) -> Column:
    """The items of a document with their definition as text; none for a missing list."""
    each = F.transform(items, lambda x: F.struct(x[name].alias("name"), F.to_json(x, {"ignoreNullFields": "false"}).alias("definition")))
    return F.coalesce(each, F.array().cast(_ITEM))


def _differences(old: Column, new: Column, kind: str) -> Column:
    """Items of either list that the other lacks, or has with another definition; whole definitions are compared first."""
    gone, came = F.array_except(old, new), F.array_except(new, old)
    named = lambda items, name: F.filter(items, lambda x: x["name"].eqNullSafe(name))
    row = lambda name, before, after, change: F.struct(
        F.lit(kind).alias("kind"), name.alias("name"), before.alias("before"), after.alias("after"), change.alias("change"))
    none = F.lit(None).cast("string")
    after = F.transform(came, lambda x: row(
        x["name"], F.get(named(gone, x["name"]), F.lit(0))["definition"], x["definition"],
        F.when(F.size(named(gone, x["name"])) > 0, F.lit("changed")).otherwise(F.lit("added"))))
    lost = F.filter(gone, lambda x: F.size(named(came, x["name"])) == 0)
    return F.concat(after, F.transform(lost, lambda x: row(x["name"], x["definition"], none, F.lit("removed"))))


def schema_drift(before: DataFrame, after: DataFrame, keys: Sequence[str] = ("instance_id",)) -> DataFrame:
    """Columns and indexes that were added, removed or changed between two sets of `assemble_schemas` rows.

    Documents are compared table by table, on the placement they come with; only differences become rows.
    """
    place = [*keys, "schema_name", "table_name"]
    side = lambda rows, at: rows.select(*place, F.col("columns").alias(f"_columns_{at}"), F.col("indexes").alias(f"_indexes_{at}"))
    both = side(before, "old").join(side(after, "new"), place, "full_outer").filter(
        ~(F.col("_columns_old").eqNullSafe(F.col("_columns_new")) & F.col("_indexes_old").eqNullSafe(F.col("_indexes_new"))))
    listed = both.select(*place, *(
        _listed(F.col(f"_{field}_{at}"), name).alias(f"_{field}_{at}") for field, name in (("columns", "name"), ("indexes", "index_name")) for at in ("old", "new")))
    found = F.concat(*(_differences(F.col(f"_{field}_old"), F.col(f"_{field}_new"), kind) for field, kind in (("columns", "column"), ("indexes", "index"))))
    return listed.select(*place, F.inline(found))
