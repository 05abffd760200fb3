"""The lake: layout, types, pruning, sizes, compaction; envelopes and reports."""

import datetime as dt
import json
import re
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fleetgauge import (
    compact_lake, cut_points, envelopes, isolated, latest_in_lake, object_store_settings, payloads, read_lake, register_views, run_tools, shared_dir,
    topic_of, write_envelopes, write_lake, write_report,
)
from fleetgauge.schemas import DATASETS, METRICS

DAY = dt.date(2026, 4, 24)


def metrics(spark, *rows):
    return spark.createDataFrame([(i, "c", name, value, ts) for i, name, value, ts in rows], METRICS)


def files(base, pattern="**/*.parquet"):
    """Data files; the bounds of the folders are kept apart."""
    found = (path.relative_to(base) for path in Path(base).glob(pattern))
    return sorted(str(path) for path in found if path.parts[0] != "_bounds")


def spoil(base, pattern):
    """Makes files unreadable, so that a read that opens one of them fails."""
    for name in files(base, pattern):
        path = Path(base) / name
        path.write_bytes(b"x" * path.stat().st_size)
        path.with_name(f".{path.name}.crc").unlink(missing_ok=True)


def test_round_trip_and_layout(spark, tmp_path):
    base = str(tmp_path)
    rows = metrics(spark, ("101", "a", 1.5, "2026-04-24 10:00:00"), ("007", "b", 2.5, "2026-04-24 10:00:00"),
                   ("101", "c", None, "2026-04-24 10:00:00"))
    write_lake(rows, base, "metrics", date=DAY)
    assert {str(Path(f).parent) for f in files(base)} == {
        "metrics/instance_id=101/date=2026-04-24", "metrics/instance_id=007/date=2026-04-24"}
    assert len(files(base)) == 2
    back = read_lake(spark, base, "metrics")
    assert dict(back.dtypes)["instance_id"] == "string" and dict(back.dtypes)["date"] == "date"
    assert Counter(back.drop("date").select(*rows.columns).collect()) == Counter(rows.collect())


def test_empty_write_makes_no_file(spark, tmp_path):
    write_lake(metrics(spark), str(tmp_path), "metrics")
    assert files(tmp_path) == []


def test_appends_and_today(spark, tmp_path):
    row = ("i", "a", 1.0, "2026-04-24 10:00:00")
    for _ in range(2):
        write_lake(metrics(spark, row), str(tmp_path), "metrics")
    back = read_lake(spark, str(tmp_path), "metrics").collect()
    today = dt.datetime.now(dt.timezone.utc).date()
    assert len(back) == 2 and all(abs((r.date - today).days) <= 1 for r in back)


def test_unsigned_counters_of_foreign_files(spark, tmp_path):
    """A file another writer made: UINT_64 columns, the id also inside the file."""
    folder = tmp_path / "index-usage" / "instance_id=42" / "date=2026-04-24"
    folder.mkdir(parents=True)
    top = 2**64 - 1
    pq.write_table(pa.table({
        "instance_id": ["42"], "cluster_id": ["c"], "schema_name": ["s"], "table_name": ["t"], "index_name": ["k"],
        "count_read": pa.array([top], pa.uint64()), "count_write": pa.array([0], pa.uint64()), "timestamp": ["2026-04-24 10:00:00"],
    }), folder / "chunk_000001.parquet")
    row = read_lake(spark, str(tmp_path), "index-usage").first()
    assert (row.instance_id, int(row.count_read), int(row.count_write), row.date) == ("42", top, 0, DAY)
    base = str(tmp_path / "copy")
    write_lake(read_lake(spark, str(tmp_path), "index-usage"), base, "index-usage", date=DAY)
    again = read_lake(spark, base, "index-usage")
    assert int(again.first().count_read) == top and int(again.agg(F.sum("count_read")).first()[0]) == top


def test_date_range_cuts_by_timestamp(spark, tmp_path):
    base = str(tmp_path)
    for day, ts in ((23, "2026-04-23 23:58:00"), (24, "2026-04-23 23:59:00"), (24, "2026-04-24 12:00:00"),
                    (25, "2026-04-24 23:59:59"), (25, "2026-04-25 00:00:00"), (26, "2026-04-26 00:00:00")):
        write_lake(metrics(spark, ("i", "a", 1.0, ts), ("j", "a", 1.0, ts)), base, "metrics", date=dt.date(2026, 4, day))
    got = read_lake(spark, base, "metrics", instance="i", since="2026-04-24", until=DAY)
    assert sorted(r.timestamp for r in got.collect()) == ["2026-04-24 12:00:00", "2026-04-24 23:59:59"]
    plan = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    folders, pushed = (re.search(rf"{part}: (.*)", plan)[1] for part in ("PartitionFilters", "PushedFilters"))
    assert "date" in folders and "instance_id" in folders and "timestamp" in pushed


@pytest.mark.parametrize("written", [dt.date(2026, 4, 25), dt.date(2026, 4, 29), dt.date(2026, 9, 1)])
def test_rows_that_were_filled_in_later_are_found(spark, tmp_path, written):
    base = str(tmp_path)
    write_lake(metrics(spark, *(("i", "a", float(h), f"2026-04-24 {h:02}:00:00") for h in range(4))), base, "metrics", date=written)
    assert read_lake(spark, base, "metrics", since=DAY, until=DAY).count() == 4
    assert read_lake(spark, base, "metrics", since="2026-04-25", until="2026-12-31").count() == 0
    assert read_lake(spark, base, "metrics", until=DAY, written_until=written).count() == 4
    assert read_lake(spark, base, "metrics", until=DAY, written_until=written - dt.timedelta(days=1)).count() == 0


def test_reads_by_time_open_what_may_hold_it(spark, tmp_path):
    """Both ends of a range leave folders out, and rows that were filled in later are found all the same."""
    base, day = str(tmp_path), lambda n: dt.date(2026, 4, n)
    for n in range(20, 28):
        write_lake(metrics(spark, ("i", "a", 1.0, f"2026-04-{n} 10:00:00"), ("j", "a", 1.0, f"2026-04-{n} 11:00:00")), base, "metrics", date=day(n))
    write_lake(metrics(spark, ("j", "late", 1.0, "2026-04-22 12:00:00")), base, "metrics", date=day(27))
    for n in (20, 21, 24, 25, 26):
        spoil(base, f"**/date=2026-04-{n}/*.parquet")
    got = read_lake(spark, base, "metrics", since=day(22), until=day(23))
    assert sorted((r.instance_id, r.metric_name, r.timestamp[8:10]) for r in got.collect()) == [
        ("i", "a", "22"), ("i", "a", "23"), ("j", "a", "22"), ("j", "a", "23"), ("j", "late", "22")]
    plan = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    folders = re.search(r"PartitionFilters: (.*)", plan)[1]
    assert ">= 2026-04-22" in folders and all(f"2026-04-{n}" in folders for n in (24, 25, 26)) and "2026-04-27" not in folders
    spoil(base, "**/instance_id=j/**/*.parquet")
    spoil(base, "**/instance_id=i/date=2026-04-27/*.parquet")
    assert read_lake(spark, base, "metrics", instance="i", since=day(22), until=day(23)).count() == 2


def test_a_write_under_way_hides_nothing(spark, tmp_path, monkeypatch):
    from fleetgauge.sources import bounds
    base, row = str(tmp_path), lambda n: metrics(spark, ("i", "a", 1.0, f"2026-04-{n} 10:00:00"))
    write_lake(row(25), base, "metrics", date=dt.date(2026, 4, 25))
    read = lambda: read_lake(spark, base, "metrics", until="2026-04-24").count()
    note = bounds.note
    monkeypatch.setattr(bounds, "note", lambda *a: None)  # the writer dies before it notes what it wrote
    write_lake(row(20), base, "metrics", date=dt.date(2026, 4, 25))
    assert read() == 1
    write_lake(row(21), base, "metrics", date=F.to_date(F.lit("2026-04-25")))
    assert read() == 2
    monkeypatch.setattr(bounds, "note", note)
    bounds.fold(spark, base, "metrics")
    assert read() == 2 and bounds.unfinished(bounds.known(spark, base, "metrics")).count() == 2
    write_lake(row(22), base, "metrics", date=F.to_date(F.lit("2026-04-26")))
    write_lake(metrics(spark), base, "metrics", date=dt.date(2026, 4, 28))
    bounds.fold(spark, base, "metrics")
    assert read() == 3 and bounds.known(spark, base, "metrics").filter("done").count() == 2


def test_newest_rows_open_one_folder_per_instance(spark, tmp_path):
    base, day = str(tmp_path), lambda n: dt.date(2026, 4, n)
    for n in (20, 21, 22):
        write_lake(metrics(spark, ("i", "a", 1.0, f"2026-04-{n} 10:00:00"), ("i", "a", 2.0, f"2026-04-{n} 09:00:00"), *(
            [("gone", "a", 1.0, f"2026-04-{n} 08:00:00")] if n < 22 else [])), base, "metrics", date=day(n))
    write_lake(metrics(spark, ("i", "old", 1.0, "2026-04-19 10:00:00")), base, "metrics", date=day(25))
    spoil(base, "**/date=2026-04-20/*.parquet"), spoil(base, "**/date=2026-04-25/*.parquet"), spoil(base, "**/instance_id=i/date=2026-04-21/*.parquet")
    got = latest_in_lake(spark, base, "metrics")
    assert sorted((r.instance_id, r.timestamp) for r in got.collect()) == [("gone", "2026-04-21 08:00:00"), ("i", "2026-04-22 10:00:00")]
    other = str(tmp_path / "plain")  # a lake that something else wrote has no bounds
    metrics(spark, ("i", "a", 1.0, "2026-04-20 10:00:00"), ("i", "a", 1.0, "2026-04-21 10:00:00")).withColumn("date", F.lit(DAY)).write.partitionBy(
        "instance_id", "date").parquet(f"{other}/metrics")
    assert [r.timestamp for r in latest_in_lake(spark, other, "metrics").collect()] == ["2026-04-21 10:00:00"]
    assert read_lake(spark, other, "metrics", until="2026-04-20").count() == 1


def test_rows_per_file_and_compaction(spark, tmp_path):
    base = str(tmp_path)
    rows = spark.range(250).select(F.lit("i").alias("instance_id"), F.lit("c").alias("cluster_id"), F.lit("a").alias("metric_name"),
                                   F.col("id").cast("double").alias("value"), F.lit("2026-04-24 10:00:00").alias("timestamp"))
    write_lake(rows, base, "metrics", date=DAY, rows_per_file=100)
    assert len(files(base)) == 3
    write_lake(rows, base, "metrics", date=DAY + dt.timedelta(days=1), rows_per_file=100)
    compact_lake(spark, base, "metrics", since=DAY, until=DAY.isoformat())
    assert len(files(base, "**/date=2026-04-24/*.parquet")) == 1 and len(files(base, "**/date=2026-04-25/*.parquet")) == 3
    back = read_lake(spark, base, "metrics")
    assert back.count() == 500 and back.agg(F.sum("value")).first()[0] == 2 * 250 * 249 / 2
    compact_lake(spark, base, "metrics", into=str(tmp_path / "other"))
    assert read_lake(spark, str(tmp_path / "other"), "metrics").count() == 500


def test_compaction_takes_whole_closed_folders_only(spark, tmp_path):
    base, today = str(tmp_path), dt.datetime.now(dt.timezone.utc).date()
    for day in (DAY, DAY, today, today):
        write_lake(metrics(spark, ("i", "a", 1.0, "2026-04-24 10:00:00"), ("j", "a", 2.0, "2026-04-24 10:00:00")), base, "metrics", date=day)
    with pytest.raises(TypeError):
        compact_lake(spark, base, "metrics", F.col("value") > 1)
    with pytest.raises(ValueError):
        compact_lake(spark, base, "metrics", until=today)
    compact_lake(spark, base, "metrics", instance="i")
    count = lambda instance, day: len(files(base, f"**/instance_id={instance}/date={day}/*.parquet"))
    assert [count(i, d) for i in "ij" for d in (DAY, today)] == [1, 2, 2, 2]
    assert read_lake(spark, base, "metrics").count() == 8
    compact_lake(spark, base, "metrics", since="2020-01-01", until="2020-01-02")
    assert read_lake(spark, base, "metrics").count() == 8


def test_append_during_compaction_survives(spark, tmp_path, monkeypatch):
    from fleetgauge.sinks import lake
    base, row = str(tmp_path), ("i", "a", 1.0, "2026-04-24 10:00:00")
    for _ in range(2):
        write_lake(metrics(spark, row), base, "metrics", date=DAY)
    plain = lake.sized

    def slow(rows):
        monkeypatch.setattr(lake, "sized", plain)
        write_lake(metrics(spark, row), base, "metrics", date=DAY)
        return plain(rows)

    monkeypatch.setattr(lake, "sized", slow)
    with pytest.raises(RuntimeError):
        compact_lake(spark, base, "metrics")
    assert read_lake(spark, base, "metrics").count() == 3


def test_append_while_folders_are_replaced_is_told(spark, tmp_path, monkeypatch):
    """An append after the last look at the folders would be replaced silently; the error names it."""
    from fleetgauge.sinks import lake
    base, row = str(tmp_path), ("i", "a", 1.0, "2026-04-24 10:00:00")
    for _ in range(2):
        write_lake(metrics(spark, row), base, "metrics", date=DAY)
    frames = type(spark.range(1))
    plain, files = lake.sized, frames.inputFiles

    def listed(frame):
        found = files(frame)
        monkeypatch.setattr(frames, "inputFiles", files)
        write_lake(metrics(spark, row), base, "metrics", date=DAY)  # the listing does not hold its file any more
        return found

    def staging(rows):
        monkeypatch.setattr(lake, "sized", plain)
        monkeypatch.setattr(frames, "inputFiles", listed)
        return plain(rows)

    monkeypatch.setattr(lake, "sized", staging)
    with pytest.raises(RuntimeError, match="repeat these writes"):
        compact_lake(spark, base, "metrics")


def test_views(spark, tmp_path):
    for dataset, schema in DATASETS.items():
        write_lake(spark.createDataFrame([tuple("x" if f.dataType.typeName() == "string" else None for f in schema)], schema),
                   str(tmp_path), dataset, date=DAY)
    names = register_views(spark, str(tmp_path))
    assert names == ["metrics", "query_digests", "index_usage", "samples", "wait_events"]
    assert [spark.sql(f"SELECT count(*) FROM {name} WHERE date = DATE'2026-04-24'").first()[0] for name in names] == [1] * 5


def test_object_store_is_settings_only():
    assert object_store_settings("us-east-1") == {"spark.hadoop.fs.s3a.endpoint.region": "us-east-1"}
    assert object_store_settings(endpoint="http://store:9000")["spark.hadoop.fs.s3a.path.style.access"] == "true"


def test_shared_folder_is_the_configured_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


FINDINGS = ("instance_id string, ordinal int, rule_id string, category string, severity string, variable string, "
            "current_value string, description string")
DUPLICATES = ("instance_id string, database string, `table` string, duplicate_index string, overlaps_with string, "
              "columns array<string>, drop_statement string, is_unique boolean")
UUID4 = re.compile(r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")


@pytest.fixture
def messages(spark):
    instances = spark.createDataFrame([("a", "c1"), ("b", "c2")], "instance_id string, cluster_id string")
    findings = spark.createDataFrame([("a", 5, "r5", "x", "note", "v", "", "d"), ("a", 9, "r9", "x", "critical", "v", "<1>", "d"),
                                      ("a", 2, "r2", "x", "note", "v", "1", "d")], FINDINGS)
    duplicates = spark.createDataFrame([("b", "s", f"t{n}", f"k{k}", "l", ["x"], "drop", False) for n in range(25) for k in (2, 1)], DUPLICATES)
    schemas = spark.createDataFrame([("a", "s", "t", None), ("a", "s", "u", None)],
                                    "instance_id string, schema_name string, table_name string, columns array<string>")
    made = payloads(instances, findings=findings, duplicates=duplicates, schemas=schemas)
    return lambda seed="x": envelopes(instances, made, "2026-04-24 10:00:00", seed=seed)


def test_envelopes(messages):
    rows = messages().collect()
    by_tool = {}
    for r in rows:
        assert UUID4.match(r.run_id) and r.collected_at == "2026-04-24 10:00:00" and r.cluster_id == {"a": "c1", "b": "c2"}[r.instance_id]
        by_tool.setdefault((r.tool, r.instance_id), []).append(r)
    findings = json.loads(by_tool["pt-variable-advisor", "a"][0].json_payload)["findings"]
    assert [f["rule_id"] for f in findings] == ["r9", "r2", "r5"] and findings[0]["current_value"] == "<1>"
    assert list(findings[0]) == ["rule_id", "category", "severity", "variable", "current_value", "description"]
    assert by_tool["pt-variable-advisor", "b"][0].json_payload == '{"findings":null}'
    assert by_tool["pt-duplicate-key-checker", "a"][0].json_payload == '{"findings":null}'
    pieces = by_tool["pt-duplicate-key-checker", "b"]
    tables = [[(f["table"], f["duplicate_index"]) for f in json.loads(r.json_payload)["findings"]] for r in pieces]
    assert sorted(tables) == sorted([(f"t{n}", "k1"), (f"t{n}", "k2")] for n in range(25))
    schemas = by_tool["table-schema", "a"]
    assert len(schemas) == 2 and all(json.loads(r.json_payload)["columns"] is None for r in schemas)
    assert all(len({r.run_id for r in group}) == 1 for group in by_tool.values())
    assert len({group[0].run_id for group in by_tool.values()}) == len(by_tool)


def test_index_findings_of_an_instance_are_one_envelope(spark):
    instances = spark.createDataFrame([("a", "c"), ("b", "c"), ("none", "c")], "instance_id string, cluster_id string")
    found = [(i, f"s{n % 2}", f"t{n:03}", f"k{k}", "l", ["x"] * k, 'drop "it"', False) for i, tables in (("a", 200), ("b", 3)) for n in range(tables) for k in (2, 1)]
    duplicates = spark.createDataFrame(found, DUPLICATES)
    tables = duplicates.select("instance_id", F.col("database").alias("table_schema"), F.col("table").alias("table_name")).distinct()
    cuts = cut_points(tables, ["instance_id"], ["table_schema", "table_name"], fraction=1, every=30)
    assert [(r.instance_id, len(r.cuts)) for r in cuts.collect()] == [("a", 6)]
    fields = ("database", "table", "duplicate_index", "overlaps_with", "columns", "drop_statement")

    def whole(instance):
        rows = sorted((r[1:7] for r in found if r[0] == instance), key=lambda r: (r[0], r[1], len(r[4]), r[2]))
        return [dict(zip(fields, row)) for row in rows]

    for given, parts in ((cuts, [0, 1, 2, 3, 4, 5, 6]), (None, [0])):
        hot = spark.createDataFrame([("a",)], "instance_id string") if given else None
        made = payloads(instances, duplicates=duplicates, schemas=duplicates.select("instance_id", "table").limit(1), hot=hot, per_table=False, cuts=given)
        rows = sorted(envelopes(instances, made, "t", seed="x", hot=hot).collect(), key=lambda r: r.part)
        index = [r for r in rows if r.tool == "pt-duplicate-key-checker"]
        of = lambda name: [r for r in index if r.instance_id == name]
        assert [r.part for r in of("a")] == parts and [r.part for r in of("b")] == [r.part for r in of("none")] == [0]
        assert all(len({r.run_id for r in of(name)}) == 1 for name in ("a", "b", "none"))
        assert [f for r in of("a") for f in json.loads(r.json_payload)["findings"]] == whole("a")
        assert json.loads(of("b")[0].json_payload)["findings"] == whole("b") and of("none")[0].json_payload == '{"findings":null}'
        assert max(len(json.loads(r.json_payload)["findings"]) for r in of("a")) == (2 * 30 if given else 400)
        assert [r.part for r in rows if r.tool == "table-schema"] == [0]
    text = '{"findings":' + json.dumps(whole("b"), separators=(",", ":")) + "}"
    assert of("b")[0].json_payload == text


def test_run_ids_survive_a_second_evaluation(messages):
    assert Counter(messages().collect()) == Counter(messages().collect())
    assert not {r.run_id for r in messages("x").collect()} & {r.run_id for r in messages("y").collect()}


def test_all_tools_failed(spark):
    with pytest.raises(ValueError):
        envelopes(spark.createDataFrame([("a", "c")], "instance_id string, cluster_id string"), {}, "t")


def test_tools_that_fail_leave_the_others(spark):
    instances = spark.createDataFrame([("a", "c")], "instance_id string, cluster_id string")
    schemas = spark.createDataFrame([("a", "s", "t")], "instance_id string, schema_name string, table_name string")

    def gone():
        raise OSError("no route")
    tools = {"schemas": lambda: schemas, "summaries": lambda: schemas.withColumn("table_name", F.raise_error(F.lit("gone away"))), "duplicates": gone}
    rows, failures = run_tools(instances, tools, "t", seed="x")
    assert [r.tool for r in rows.collect()] == ["table-schema"]
    errors = {r.name: r.error for r in failures.collect()}
    assert set(errors) == {"summaries", "duplicates"} and errors["duplicates"] == "OSError: no route" and "gone away" in errors["summaries"]
    with pytest.raises(ValueError, match="no route"):
        run_tools(instances, {"duplicates": gone}, "t")
    done, failures = isolated(spark, {})
    assert done == {} and failures.count() == 0


def test_topics(spark, messages, tmp_path):
    tools = ["pt-variable-advisor", "pt-duplicate-key-checker", "pt-mysql-summary", "table-schema", "schema-drift", "unknown", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(tools)], "i int, tool string")
    assert [r[0] for r in rows.orderBy("i").select(topic_of(F.col("tool"))).collect()] == [
        "scout.pt-variable-advisor", "scout.pt-schema-checks", "scout.pt-mysql-summary", "scout.table-schemas",
        "scout.schema-drift", "", "", ""]
    write_envelopes(messages(), str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out").glob("topic=*")} == {
        "topic=scout.pt-variable-advisor", "topic=scout.pt-schema-checks", "topic=scout.table-schemas"}


def test_report_keeps_nulls(spark, tmp_path):
    write_report(spark.createDataFrame([("a", None)], "instance_id string, lag long"), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first()[0] == '{"instance_id":"a","lag":null}'
