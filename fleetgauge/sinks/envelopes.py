"""Results as messages: a JSON payload with who, what and when around it."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.advisor import severity_rank
from ..operators.isolation import isolated
from ..operators.skew import spread, spread_join
from ..sources.catalogs import told_apart

KEEP_NULLS = {"ignoreNullFields": "false"}
TOOL_VERSION = "fleetgauge-1.0"

# Tool names and the topics their messages go to.
TOPICS = {
    "pt-variable-advisor": "scout.pt-variable-advisor",
    "pt-duplicate-key-checker": "scout.pt-schema-checks",
    "pt-mysql-summary": "scout.pt-mysql-summary",
    "table-schema": "scout.table-schemas",
    "schema-drift": "scout.schema-drift",
}
TOOLS = tuple(TOPICS)
# Tools with a message per table, of which one instance may have very many.
PER_TABLE = ("pt-duplicate-key-checker", "table-schema")
NO_FINDINGS = '{"findings":null}'


def topic_of(tool: Column) -> Column:
    """The topic of a tool, '' for any other text."""
    topics = F.create_map(*(F.lit(text) for pair in TOPICS.items() for text in pair))
    return F.coalesce(F.element_at(topics, tool), F.lit(""))


def _run_id(seed: str, *parts: Column) -> Column:
    """A version 4 UUID drawn from the run's random seed and `parts`.

    `uuid()` would give a row another id whenever its task runs again.
    """
    digits = F.md5(F.concat_ws("|", F.lit(seed), *parts))
    variant = F.substr(F.lit("89ab"), F.conv(F.substring(digits, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws(
        "-", F.substring(digits, 1, 8), F.substring(digits, 9, 4), F.concat(F.lit("4"), F.substring(digits, 14, 3)),
        F.concat(variant, F.substring(digits, 18, 3)), F.substring(digits, 21, 12))


def _gathered(findings: DataFrame, fields: Sequence[str], order: Sequence[Column], grain: Sequence[str]) -> DataFrame:
    entry = F.struct(F.struct(*order).alias("order"), F.struct(*fields).alias("finding"))
    return findings.groupBy(*told_apart("instance_id", *grain)).agg(F.sort_array(F.collect_list(entry)).alias("_list"))


def _finding_lists(findings: DataFrame, fields: Sequence[str], order: Sequence[Column], grain: Sequence[str] = ()) -> DataFrame:
    """(instance_id, json_payload): `{"findings": [...]}` per instance and grain."""
    lists = _gathered(findings, fields, order, grain)
    return lists.select("instance_id", F.to_json(F.struct(F.col("_list.finding").alias("findings")), KEEP_NULLS).alias("json_payload"))


def _part(place: Column, cuts: Column) -> Column:
    """How many of the sorted `cuts` are not behind `place`, by halving; 0 without cuts."""
    steps = F.array(*(F.lit(1 << power) for power in reversed(range(20))))
    passed = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(cuts, n + step - 1) <= place, n + step).otherwise(n))
    return F.when(cuts.isNull(), F.lit(0)).otherwise(passed)


def _parted_lists(findings: DataFrame, fields: Sequence[str], order: Sequence[Column], cuts: DataFrame | None) -> DataFrame:
    """(instance_id, part, json_payload): `{"findings": [...]}` per instance by database, table and `order`, divided at `cuts`.

    The lists of an instance's parts, one behind the other, are its whole list.
    """
    tables = _gathered(findings, fields, order, ("database", "table"))
    listed = F.to_json(F.col("_list.finding"), KEEP_NULLS)
    texts = tables.select("instance_id", "database", "table", F.substr(listed, F.lit(2), F.length(listed) - 2).alias("text"))
    if cuts is None:
        placed = texts.withColumn("part", F.lit(0))
    else:
        place = F.struct(F.col("database").alias("table_schema"), F.col("table").alias("table_name"))
        placed = texts.join(F.broadcast(cuts), "instance_id", "left").withColumn("part", _part(place, F.col("cuts")))
    parts = placed.groupBy("instance_id", "part").agg(F.sort_array(F.collect_list(F.struct("database", "table", "text"))).alias("_texts"))
    body = F.concat(F.lit('{"findings":['), F.array_join("_texts.text", ","), F.lit("]}"))
    return parts.select("instance_id", "part", body.alias("json_payload"))


def _or_none(instances: DataFrame, lists: DataFrame) -> DataFrame:
    """One list per instance at most, and null for an instance without one."""
    every = instances.select("instance_id").join(lists, "instance_id", "left")
    return every.select("instance_id", F.coalesce("json_payload", F.lit(NO_FINDINGS)).alias("json_payload"))


def _many_or_none(instances: DataFrame, lists: DataFrame, hot: DataFrame | None) -> DataFrame:
    """The same where an instance may have very many lists, those of `hot` spread over tasks.

    A left join would bring all lists of an instance into one task and hold them there beside its row. So lists are joined as
    the rows that pass by, and instances without one are found by the ids of the others. Both read the lists as they
    were dealt out once: the ids are taken by a condition on all columns, and nothing is left to be filtered before.
    """
    known = instances.select("instance_id")
    if hot is None:
        left, right = lists.withColumn("_slice", F.lit(0)), known.withColumn("_slice", F.lit(0))
    else:
        left, right = spread(lists, known, ["instance_id"], F.col("json_payload"), hot)
    dealt = left.filter("instance_id IS NOT NULL AND _slice IS NOT NULL").repartition("instance_id", "_slice")
    rest = [name for name in dealt.columns if name not in ("instance_id", "json_payload")]
    found = dealt.groupBy("instance_id").agg(F.max(F.struct(F.length("json_payload"), *rest)).alias("_most")).filter("_most IS NOT NULL")
    texts = {"json_payload": F.lit(NO_FINDINGS)} | ({"part": F.lit(0)} if "part" in rest else {})
    none = known.join(found, "instance_id", "left_anti").withColumns(texts).select(*lists.columns)
    return dealt.join(right, ["instance_id", "_slice"]).select(*lists.columns).unionByName(none)


def payloads(
    instances: DataFrame, *, findings: DataFrame | None = None, duplicates: DataFrame | None = None,
    summaries: DataFrame | None = None, schemas: DataFrame | None = None, hot: DataFrame | None = None,
    per_table: bool = True, cuts: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Tool -> (instance_id, json_payload) for every result that is there; a failed tool is left out.

    Rule findings are at most one per rule and make one payload per instance. Index findings have no such bound: they make
    one payload per table that has some, as schemas make one per table, and one with null for an instance without any. `hot`
    is as in `envelopes`.

    Without `per_table` the index findings of an instance are one payload, by database and table, as the tool sends them. One value
    cannot hold those of any server, so `cuts` (instance_id, an array of table_schema and table_name: `cut_points`) divides the
    payload of a large one into parts, which are rows of their own with a number in `part`.
    """
    made = {}
    if findings is not None:
        fields = ("rule_id", "category", "severity", "variable", "current_value", "description")
        order = [severity_rank(F.col("severity")).alias("rank"), F.col("ordinal")]
        made["pt-variable-advisor"] = _or_none(instances, _finding_lists(findings, fields, order))
    if duplicates is not None:
        fields = ("database", "table", "duplicate_index", "overlaps_with", "columns", "drop_statement")
        order = [F.size("columns").alias("width"), F.col("duplicate_index")]
        lists = (_finding_lists(duplicates, fields, order, ("database", "table")) if per_table
                 else _parted_lists(duplicates, fields, order, cuts))
        made["pt-duplicate-key-checker"] = _many_or_none(instances, lists, hot)
    for tool, rows in (("pt-mysql-summary", summaries), ("table-schema", schemas)):
        if rows is not None:
            body = F.struct(*(name for name in rows.columns if name != "instance_id"))
            made[tool] = rows.select("instance_id", F.to_json(body, KEEP_NULLS).alias("json_payload"))
    return made


def run_tools(
    instances: DataFrame, tools: Mapping[str, Callable[[], DataFrame]], collected_at: str, *,
    tool_version: str = TOOL_VERSION, seed: str | None = None, hot: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The envelopes of all tools that succeed, and (name, error) of those that fail; if all fail, ValueError.

    `tools` has what `payloads` takes under its names (findings, duplicates, summaries, schemas), as functions that make the
    frames. Each is computed by itself, so that one that fails while it runs does not take the others along.
    """
    done, failures = isolated(instances.sparkSession, tools)
    return envelopes(instances, payloads(instances, **done, hot=hot), collected_at, tool_version=tool_version, seed=seed, hot=hot), failures


def union_envelopes(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def envelopes(
    instances: DataFrame, made: Mapping[str, DataFrame], collected_at: str, *,
    tool_version: str = TOOL_VERSION, seed: str | None = None, hot: DataFrame | None = None,
) -> DataFrame:
    """All payloads as envelopes; `instances` has (instance_id, cluster_id).

    Envelopes of one instance and tool share a run id: the tables of a schema
    run or of an index check. `seed` is drawn once per run. `hot` has the
    instance_id of instances with very many tables, if there are any: their
    messages per table are spread over tasks. Where payloads come in parts
    (see `payloads`), an envelope has a row per part, numbered in `part`.
    """
    if not made:
        raise ValueError("all analysis tools failed")
    seed = seed or uuid.uuid4().hex
    clusters = instances.select("instance_id", "cluster_id")

    def placed(tool: str, rows: DataFrame) -> DataFrame:
        if hot is None or tool not in PER_TABLE:
            return rows.join(clusters, "instance_id")
        known = clusters.withColumn("_known", F.lit(True))
        return spread_join(rows, known, ["instance_id"], F.col("json_payload"), hot=hot).filter("_known")

    in_parts = any("part" in rows.columns for rows in made.values())

    def part(rows: DataFrame) -> list[Column]:
        return [(F.col("part") if "part" in rows.columns else F.lit(0)).alias("part")] if in_parts else []

    return union_envelopes([
        placed(tool, rows).select(
            _run_id(seed, F.col("instance_id"), F.lit(tool)).alias("run_id"), "instance_id", "cluster_id",
            F.lit(tool).alias("tool"), F.lit(tool_version).alias("tool_version"),
            F.lit(collected_at).alias("collected_at"), "json_payload", *part(rows),
        ) for tool, rows in made.items()
    ])


def write_envelopes(messages: DataFrame, path: str | None = None, kafka: Mapping[str, str] | None = None) -> None:
    """To Kafka by topic (needs the connector jar), or to Parquet in one folder per topic."""
    routed = messages.withColumn("topic", topic_of(F.col("tool")))
    if kafka is not None:
        value = F.to_json(F.struct(*messages.columns), KEEP_NULLS)
        routed.select("topic", F.col("instance_id").alias("key"), value.alias("value")).write.format(
            "kafka").options(**kafka).save()
    else:
        routed.write.mode("append").partitionBy("topic").parquet(path)


def write_report(rows: DataFrame, path: str) -> None:
    """Findings or summaries as JSON lines with null fields kept."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
