"""Catalog frames: tables, columns, indexes, engines, server.

Arrays are gathered per table or per index of one server. The server bounds
them (16 parts per index, 4096 columns per table), so they stay small whatever
the size of the fleet, and a large instance spreads over its tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import is_user_schema, or_empty

INSTANCE = ("instance_id",)


def _in_order(position: str, *fields: Column | str) -> Column:
    """Structs of a group, sorted by their position."""
    return F.sort_array(F.collect_list(F.struct(F.col(position).alias("_at"), *fields)))


def dealt_by_table(rows: DataFrame, keys: Sequence[str], schema: str = "table_schema") -> DataFrame:
    """Rows brought together by table, so that groups, windows and joins per table need no shuffle of their own.

    The table's name comes first: what sorts by these columns tells most rows apart by it.
    """
    return rows.repartition("table_name", schema, *keys)


def told_apart(*names: str) -> list[Column]:
    """Columns to group by, a hash of them in front: a group's list makes Spark sort, and the hash settles most comparisons."""
    return [F.xxhash64(*names).alias("_hash"), *(F.col(name) for name in names)]


def index_catalog(raw: DataFrame, keys: Sequence[str] = INSTANCE) -> DataFrame:
    """One row per index with its ordered columns, uniqueness and type.

    Uniqueness and type are those of the first part. A functional part has no
    column name and stays in the list as NULL. Rows are dealt out by table, so
    what is gathered per table later needs no shuffle of its own.
    """
    has_type = "index_type" in raw.columns
    kind = F.col("index_type") if has_type else F.lit(None).cast("string")
    parts = _in_order("seq_in_index", "column_name", (F.col("non_unique") != 0).alias("non_unique"),
                      kind.alias("index_type"))
    needed = raw.filter(is_user_schema(F.col("table_schema"))).select(
        *keys, "table_schema", "table_name", "index_name", "seq_in_index", "column_name", "non_unique", *["index_type"] * has_type)
    grouped = dealt_by_table(needed, keys).groupBy(
        *told_apart(*keys, "table_schema", "table_name", "index_name")).agg(parts.alias("_parts"))
    return grouped.select(
        *keys, "table_schema", "table_name", "index_name",
        F.col("_parts.column_name").alias("columns"),
        F.col("_parts")[0]["non_unique"].alias("non_unique"),
        F.col("_parts")[0]["index_type"].alias("index_type"),
    )


def table_catalog(raw: DataFrame, keys: Sequence[str] = INSTANCE) -> DataFrame:
    """Base tables of user schemas, NULL sizes as 0 and a NULL engine as ''."""
    def size(name: str) -> Column:
        return F.coalesce(F.col(name).cast("bigint"), F.lit(0).cast("bigint")).alias(name)
    base = raw.filter((F.col("table_type") == "BASE TABLE") & is_user_schema(F.col("table_schema")))
    return base.select(
        *keys, F.col("table_schema").alias("schema_name"), "table_name",
        size("table_rows"), size("data_length"), size("index_length"), or_empty(F.col("engine")).alias("engine"),
    )


def column_fields() -> list[Column]:
    """Fields of one column document, from the raw names."""
    def text(source: str, name: str) -> Column:
        return or_empty(F.col(source)).alias(name)
    return [
        F.col("column_name").alias("name"), F.col("ordinal_position").cast("int").alias("position"),
        F.col("data_type"), F.col("column_type"), (F.col("is_nullable") == "YES").alias("is_nullable"),
        text("column_key", "column_key"), text("extra", "extra"), F.col("column_default").alias("default_value"),
        text("character_set_name", "character_set"), text("collation_name", "collation"),
        text("column_comment", "column_comment"), text("generation_expression", "generation_expression"),
    ]


def column_catalog(raw: DataFrame, keys: Sequence[str] = INSTANCE) -> DataFrame:
    """One row per table with its columns in ordinal order; rows are dealt out by table, as in `index_catalog`."""
    rows = dealt_by_table(raw.filter(is_user_schema(F.col("table_schema"))), keys)
    ordered = _in_order("ordinal_position", F.struct(*column_fields()).alias("column"))
    grouped = rows.groupBy(*told_apart(*keys, "table_schema", "table_name")).agg(ordered["column"].alias("columns"))
    return grouped.select(*keys, F.col("table_schema").alias("schema_name"), "table_name", "columns")


def engines(raw: DataFrame, keys: Sequence[str] = INSTANCE) -> DataFrame:
    """Storage engines a server supports; a NULL support is dropped, as SQL's comparison does."""
    return raw.filter(F.col("support") != "NO").select(
        *keys, "engine", "support", or_empty(F.col("transactions")).alias("transactions"))


def server_info(raw: DataFrame, keys: Sequence[str] = INSTANCE) -> DataFrame:
    """The version of every server; the host name is read with it but not reported."""
    return raw.select(*keys, "version")
