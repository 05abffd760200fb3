"""Name/value rows to maps or columns, one row per server snapshot.

The server gives each name once. Where a landed frame holds a name twice, the
later row wins: by `seq`, the column with the order of the rows, or without
one by the greater raw name and value, so that the result never depends on
how Spark happened to read the files.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import or_empty

INSTANCE = ("instance_id",)


def _ranked(seq: str | None) -> Column:
    """Orders duplicates of a name; the value comes last and is what is kept."""
    order = [F.col(seq).alias("seq")] if seq else []
    return F.struct(*order, F.col("variable_name").alias("name"), or_empty(F.col("variable_value")).alias("value"))


def global_variables(raw: DataFrame, keys: Sequence[str] = INSTANCE, seq: str | None = None) -> DataFrame:
    """(*keys, vars): map of lower-cased name to value.

    Duplicates go first, in a mergeable aggregate, so what is gathered per
    snapshot is one entry per variable of a server.
    """
    name = F.lower("variable_name")
    single = raw.groupBy(*keys, name.alias("name")).agg(F.max(_ranked(seq))["value"].alias("value"))
    entries = F.collect_list(F.struct("name", "value"))
    return single.groupBy(*keys).agg(F.map_from_entries(entries).alias("vars"))


def show_to_map(raw: DataFrame, keys: Sequence[str] = INSTANCE, seq: str | None = None) -> DataFrame:
    """The same for SHOW STATUS and SHOW VARIABLES rows, landed under the same two names."""
    return global_variables(raw, keys, seq)


def variable_columns(
    raw: DataFrame, names: Iterable[str], keys: Sequence[str] = INSTANCE, seq: str | None = None, prefix: str = "",
) -> DataFrame:
    """(*keys, one text column per name), NULL where a server lacks the name.

    The form to use when the names are known, as they are for rules and
    summaries: the buffers have a fixed size and are combined before a shuffle.
    An aggregate rewrites its whole buffer for every row, so many names are
    taken in two steps, first into the columns of about as many groups as there
    are columns. Rows with other names fall into one group and cost little.
    """
    wanted = list(names)
    width = max(1, math.ceil(math.sqrt(len(wanted)))) if len(wanted) > 16 else max(1, len(wanted))
    place = f"array_position(array({', '.join(map(repr, wanted))}), lower(variable_name))" if wanted else "0L"
    placed = raw.withColumn("_place", F.expr(place)).select(
        *keys, F.expr(f"CAST(ceil(_place / {width}) AS INT) AS _group"), F.expr(f"CAST(_place % {width} AS INT) AS _slot"),
        F.when(F.col("_place") > 0, _ranked(seq)).alias("_kept"))
    grouped = placed.groupBy(*keys, "_group").agg(F.lit(0).alias("_"), *(
        F.expr(f"max(CASE WHEN _slot = {slot} THEN _kept END).value AS _slot{slot}") for slot in range(width)))
    return grouped.groupBy(*keys).agg(F.lit(0).alias("_"), *(
        F.expr(f"max(CASE WHEN _group = {-(-n // width)} THEN _slot{n % width} END) AS `{prefix}{name}`")
        for n, name in enumerate(wanted, 1))).drop("_")
