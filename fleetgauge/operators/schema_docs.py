"""One document per table: columns and indexes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.catalogs import told_apart


def assemble_schemas(
    tables: DataFrame, columns: DataFrame, indexes: DataFrame, keys: Sequence[str] = ("instance_id",)
) -> DataFrame:
    """Joins `table_catalog`, `column_catalog` and `index_catalog` frames per table.

    A table without columns or indexes gets NULL there, which is JSON null.
    """
    place = [*keys, "schema_name", "table_name"]
    per_table = indexes.withColumnRenamed("table_schema", "schema_name").groupBy(*told_apart(*place)).agg(
        F.sort_array(F.collect_list(F.struct("index_name", "non_unique", "columns", "index_type"))).alias("indexes")).drop("_hash")
    return tables.join(columns, place, "left").join(per_table, place, "left")
