"""Topology, membership, health over time, summary, counters."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fleetgauge import (
    Server, add_daily_bounds, all_failing_spans, answered, counter_delta, counter_delta_daily, counter_delta_fleet, counter_increase,
    digest_top, engines, failed, fleet_summary,
    fold_daily_bounds, global_status_metrics, health_streaks, host_identity, index_usage, innodb_metrics, jdbc_options, latest_per_instance,
    latest_snapshot, metric_like, poll_metrics, poll_outcome, processlist_metrics, read_daily_bounds, read_fleet,
    replica_status, run_dir, schema_sizes,
    status_stats, topology, topology_diff, union_instances, write_heavy_indexes,
)
from fleetgauge.sources.landed import tagged

LOG = "instance_id string, cluster_id string, ts string, failed boolean"
PAIRS = "instance_id string, variable_name string, variable_value string"


def random_log(seed, failing):
    draw, rows = random.Random(seed), []
    for i in range(5):
        state = False
        for hour in range(24 * 6):
            if draw.random() < .25:
                state = draw.random() < failing
            # Some hours are missing, some days are bad from end to end.
            if draw.random() < .9:
                bad = state or (i == 4 and 30 <= hour < 100)
                rows.append((f"i{i}", f"c{i % 2}", f"2024-01-{1 + hour // 24:02d} {hour % 24:02d}:00:00", bad))
    draw.shuffle(rows)
    return rows


def test_streaks(spark):
    rows = random_log(3, .6)
    expected, run = {}, defaultdict(int)
    for i, _, ts, failed in sorted(rows, key=lambda r: (r[0], r[2])):
        run[i] = run[i] + 1 if failed else 0
        expected[i, ts] = (run[i], run[i] >= 3)
    got = health_streaks(spark.createDataFrame(rows, LOG))
    assert {(r.instance_id, r.ts): (r.consecutive_fails, r.needs_reconnect) for r in got.collect()} == expected
    assert max(n for n, _ in expected.values()) > 48


def test_streak_threshold_and_unknown_outcome(spark):
    rows = spark.createDataFrame([("i", "c", f"2024-01-01 00:0{n}:00", f) for n, f in enumerate([True, True, None, True])], LOG)
    got = {r.ts[-5:-3]: (r.consecutive_fails, r.needs_reconnect) for r in health_streaks(rows, threshold=2).collect()}
    assert got == {"00": (1, False), "01": (2, True), "02": (0, False), "03": (1, False)}


def test_failing_spans(spark):
    rows = random_log(8, .85)
    cycles = defaultdict(list)
    for _, c, ts, failed in rows:
        cycles[c, ts].append(failed)
    expected, open_span = Counter(), {}
    for (c, ts), outcomes in sorted(cycles.items()):
        if all(outcomes):
            open_span.setdefault(c, []).append(ts)
        elif c in open_span:
            span = open_span.pop(c)
            expected[c, span[0], span[-1], len(span)] += 1
    for c, span in open_span.items():
        expected[c, span[0], span[-1], len(span)] += 1
    got = all_failing_spans(spark.createDataFrame(rows, LOG), give_up_after=7200).collect()
    assert Counter((r.cluster_id, r.down_since, r.last_seen_down, r.polls) for r in got) == expected
    assert len(expected) > 5
    for r in got:
        hours = [int(t[8:10]) * 24 + int(t[11:13]) for t in (r.down_since, r.last_seen_down)]
        assert r.seconds == (hours[1] - hours[0]) * 3600 and r.gives_up == (r.seconds >= 7200)
    assert not any(r.gives_up for r in all_failing_spans(spark.createDataFrame(rows, LOG)).collect())


def test_poll_outcome(spark):
    def rows(*keys):
        return spark.createDataFrame(list(keys), "instance_id string, timestamp string")
    due = rows(("a", "1"), ("a", "2"), ("b", "1"))
    got = poll_outcome(due, rows(("a", "1"), ("a", "1")), rows(), rows(("b", "1")))
    assert {tuple(r) for r in got.collect()} == {("a", "1", 2, 0, 0, False), ("a", "2", 0, 0, 0, True), ("b", "1", 0, 0, 1, False)}


def test_topology(spark):
    clusters = spark.createDataFrame([("a", "main.x.net"), ("b", "alone.x.net"), ("c", "plain")], "cluster_id string, endpoint string")
    hosts = spark.createDataFrame([("a", "s1", "MASTER_SESSION_ID"), ("a", "s2", None), ("c", "s3", "x")],
                                  "cluster_id string, server_id string, session_id string")
    assert {tuple(r) for r in topology(clusters, hosts).collect()} == {
        ("a", "s1", "s1.x.net", True), ("a", "s2", "s2.x.net", False), ("b", "alone.x.net", "alone.x.net", True),
        ("c", "s3", "s3", False)}


def test_identity(spark):
    rows = spark.createDataFrame([("prod", "a", "h"), ("", "a", "h"), (None, None, "h"), ("", "", "")],
                                 "o string, a string, h string")
    got = rows.select(host_identity(F.col("o"), F.col("a"), F.col("h"), F.lit("127.0.0.1"))).collect()
    assert [r[0] for r in got] == ["prod", "a", "h", "127.0.0.1"]


def test_membership(spark):
    old = spark.createDataFrame([(c, s, s) for c, s in (("a", "s1"), ("a", "s2"), ("b", "s1"), ("d", "s1"))],
                                "cluster_id string, server_id string, endpoint string")
    new = spark.createDataFrame([("a", "s1", "s1", False), ("a", "s3", "s3", True), ("a", "s4", "s4", False),
                                 ("b", "s9", "s9", False), ("e", "s5", "s5", True), ("f", "s6", "s6", False)],
                                "cluster_id string, server_id string, endpoint string, reachable boolean")
    assert {(r.cluster_id, r.server_id, r.status) for r in topology_diff(old, new).collect()} == {
        ("a", "s1", "kept"), ("a", "s2", "removed"), ("a", "s3", "added"), ("b", "s1", "kept"), ("d", "s1", "kept"),
        ("e", "s5", "added")}


def test_poller(spark):
    cycle = ("i", "c", "2024-01-01 00:00:00")
    status = spark.createDataFrame([(*cycle, n, v) for n, v in (("Queries", "12"), ("queries", "1"), ("Uptime", "x"), ("Other", "1"))],
                                   "instance_id string, cluster_id string, timestamp string, variable_name string, variable_value string")
    threads = spark.createDataFrame([(*cycle, c) for c in ("Sleep", "Query", "Query", None)],
                                    "instance_id string, cluster_id string, timestamp string, command string")
    counters = spark.createDataFrame([(*cycle, "a", 5, "enabled"), (*cycle, "b", 6, "disabled")],
                                     "instance_id string, cluster_id string, timestamp string, name string, count long, status string")
    metrics = poll_metrics(global_status_metrics(status), processlist_metrics(threads), innodb_metrics(counters))
    assert {(r.metric_name, r.value) for r in metrics.collect()} == {
        ("global_status.Queries", 12.0), ("processlist.total", 4.0), ("processlist.active", 2.0),
        ("processlist.sleeping", 1.0), ("innodb_metrics.a", 5.0)}


def test_top_digests(spark):
    columns = ["count_star", "sum_timer_wait", "sum_rows_examined", "sum_rows_sent", "sum_rows_affected", "sum_created_tmp_tables",
               "sum_created_tmp_disk_tables", "sum_no_index_used"]
    rows = [("i", "c", "t", f"d{n:03d}", None, None, 1, n // 2, 0, 0, 0, 0, 0, 0) for n in range(300)]
    rows += [("i", "c", "t", None, "x", "s", 1, 9999, 0, 0, 0, 0, 0, 0), ("i", "c", "t", "zero", "x", "s", 0, 9999, 0, 0, 0, 0, 0, 0)]
    raw = spark.createDataFrame(rows, "instance_id string, cluster_id string, timestamp string, digest string, digest_text string, "
                                "schema_name string, " + ", ".join(f"{c} long" for c in columns)).withColumns(
        {"first_seen": F.timestamp_seconds(F.lit(1704067200)), "last_seen": F.lit(None).cast("timestamp")})
    top = digest_top(raw).collect()
    assert {r.digest for r in top} == {f"d{n:03d}" for n in range(200, 300)}
    assert (top[0].digest_text, top[0].schema_name, top[0].first_seen, top[0].last_seen) == ("", "", "2024-01-01 00:00:00", "")
    assert [r.digest for r in digest_top(raw, top=3).orderBy("digest").collect()] == ["d296", "d298", "d299"]
    plan = digest_top(raw)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_index_io(spark):
    raw = spark.createDataFrame([("i", "c", "t", s, "x", n, 1, 2) for s, n in
                                 (("app", "k"), ("app", None), ("mysql", "k"), ("Sys", "k"), (None, "k"))],
                                "instance_id string, cluster_id string, timestamp string, object_schema string, object_name string, "
                                "index_name string, count_read long, count_write long")
    assert {(r.schema_name, r.index_name) for r in index_usage(raw).collect()} == {("app", "k"), ("Sys", "k")}


def test_reports(spark):
    usage = spark.createDataFrame(
        [("i", "s", f"t{n}", "k", reads, writes, "t") for n, (reads, writes) in
         enumerate([(0, 5_000_000), (3, 2_000_000), (1, 40_000_000), (2_000_000, 1_000_000)])],
        "instance_id string, schema_name string, table_name string, index_name string, count_read long, count_write long, timestamp string")
    assert [r.write_read_ratio for r in write_heavy_indexes(usage).collect()] == ["40000000.0", "UNUSED", "666666.67"]
    metrics = spark.createDataFrame([("i", "t", "global_status.Innodb_rows_read", 1.0),
                                     ("i", "t", "global_status.InnodbXrowsYread", 2.0), ("i", "t", "x", 3.0)],
                                    "instance_id string, timestamp string, metric_name string, value double")
    assert [r.value for r in metric_like(metrics).collect()] == [2.0, 1.0]


def test_snapshots_and_growth(spark):
    rows = spark.createDataFrame(
        [(i, "s", "d", "text", n, n * 10**12, f"2024-01-0{day}") for i, day, n in
         (("a", 1, 1), ("a", 2, 5), ("a", 3, 2), ("b", 1, 7), ("b", 2, 7))],
        "instance_id string, schema_name string, digest string, digest_text string, exec_count long, sum_timer_wait long, timestamp string")
    assert [r.instance_id for r in latest_snapshot(rows).collect()] == ["a"]
    assert {(r.instance_id, r.timestamp) for r in latest_per_instance(rows).collect()} == {("a", "2024-01-03"), ("b", "2024-01-02")}
    assert [tuple(r) for r in counter_delta(rows, "2024-01-02").collect()] == [("text", 5, 5.0)]
    assert [tuple(r) for r in counter_delta_fleet(rows, "2024-01-01").collect()] == [("a", "s", "d", 4, 4.0)]
    steps = counter_increase(rows, ["instance_id"], ["exec_count"]).orderBy("instance_id", "timestamp").collect()
    assert [r.exec_count_increase for r in steps] == [None, 4, 2, None, 0]


def test_summary(spark):
    status = spark.createDataFrame([("a", n, v) for n, v in (
        ("Uptime", "10"), ("QUESTIONS", "25"), ("Threads_running", "3"), ("Threads_connected", "10"),
        ("Innodb_buffer_pool_read_requests", "8"), ("Innodb_buffer_pool_reads", "2"), ("Connections", "9" * 30))] +
        [("b", "Uptime", "-1"), ("b", "Questions", "5")], PAIRS)
    variables = spark.createDataFrame([("a", "Max_Connections", "151"), ("a", "slow_query_log", ""), ("a", "port", "1")], PAIRS)
    servers = spark.createDataFrame([("a", "8.0.35"), ("b", "5.7.1"), ("c", "x")], "instance_id string, version string")
    replica = replica_status(servers, spark.createDataFrame(
        [("a", {"Slave_IO_Running": "Yes", "Seconds_Behind_Master": "12"}), ("b", {"Slave_SQL_Running": "No", "Seconds_Behind_Master": None})],
        "instance_id string, status map<string,string>"))
    kinds = engines(spark.createDataFrame([("a", "X", "YES", None), ("a", "Y", "NO", "NO"), ("a", "Z", None, None)],
                                          "instance_id string, engine string, support string, transactions string"))
    tables = spark.createDataFrame([("a", "s1", 1, 2), ("a", "s1", None, 5), ("a", "s2", 50, 50), ("a", "mysql", 1, 1)],
                                   "instance_id string, table_schema string, data_length long, index_length long")
    rows = {r.instance_id: r for r in fleet_summary(servers, status, variables, replica, kinds, tables).collect()}
    a, b, c = rows["a"], rows["b"], rows["c"]
    assert (a.uptime_seconds, a.qps, b.uptime_seconds, b.qps) == (10, 2.5, -1, 0.0)
    assert tuple(a.connections) == (151, 3, 7, 9223372036854775807, 0)
    assert (a.buffer_pool.hit_ratio_pct, b.buffer_pool.hit_ratio_pct) == (75.0, 0.0)
    assert tuple(a.replication) == (True, "Yes", "", 12) and tuple(b.replication) == (True, "", "No", None)
    assert tuple(c.replication) == (False, "", "", None) and c.engines is None and c.qps is None
    assert [tuple(e) for e in a.engines] == [("X", "YES", "")]
    assert [tuple(s) for s in a.schema_stats] == [("s2", 1, 100), ("s1", 2, 3)]
    assert a.key_variables == {"max_connections": "151", "slow_query_log": ""}
    assert {(r.schema, r.tables, r.size_bytes) for r in schema_sizes(tables).collect()} == {("s1", 2, 3), ("s2", 1, 100)}
    assert math.isclose(status_stats(status, variables).filter("instance_id = 'a'").first().qps, 2.5)


def test_reading_a_fleet(spark):
    one = tagged(spark.createDataFrame([("x", 1)], "NAME string, COUNT long"), "i1", "c", "t")
    two = tagged(spark.createDataFrame([("y",)], "Name string"), "i2", "c", "t")
    assert [tuple(r) for r in union_instances([one, two]).orderBy("instance_id").collect()] == [
        ("i1", "c", "t", "x", 1), ("i2", "c", "t", "y", None)]
    options = jdbc_options("db.example.net", 3306, "reader", "secret", "innodb_metrics")
    assert options["url"] == "jdbc:mysql://db.example.net:3306/?connectTimeout=5000&socketTimeout=30000"
    assert options["query"] == "SELECT name, count, status FROM information_schema.innodb_metrics WHERE status = 'enabled'" and "dbtable" not in options
    digests = jdbc_options("h", 1, "u", "p", "statement_digests")["query"]
    assert digests.endswith("WHERE digest IS NOT NULL AND count_star > 0 ORDER BY sum_timer_wait DESC, schema_name, digest LIMIT 100")
    assert jdbc_options("h", 1, "u", "p", "wait_events", above=7)["query"].endswith("events_waits_history_long WHERE event_id > 7")
    with pytest.raises(ValueError):
        jdbc_options("h", 1, "u", "p", "replica_status")


def test_reading_many_servers_at_once(spark):
    """A driver that answers in this process stands for the servers'; one is down, one breaks off half way."""
    def connect(host, port):
        class Connection:
            def cursor(self):
                return self

            def execute(self, statement):
                if host == "down":
                    raise OSError("no route to host")
                self.statement, self.sent = statement, 0
                names = ("Slave_IO_Running", "Seconds_Behind_Master") if statement.startswith("SHOW") else ("variable_name", "variable_value")
                self.description = [(name, None) for name in names]

            def fetchmany(self, n):
                self.sent += 1
                if self.sent == 2 and host == "broken":
                    raise OSError("gone away")
                return [] if self.sent > 1 else [("Yes", 3)] if self.statement.startswith("SHOW") else [("hostname", host.encode()), ("port", port)]

            def close(self):
                pass
        return Connection()

    servers = [Server("i1", "c", "one"), Server("i2", "c", "two", 3307), Server("i3", "d", "down"), Server("i4", "d", "broken")]
    rows = read_fleet(spark, servers, "identity", connect, "2026-04-24 10:00:00")
    assert rows.rdd.getNumPartitions() == 4
    assert sorted(tuple(r) for r in answered(rows).select("instance_id", "variable_name", "variable_value").collect()) == [
        ("i1", "hostname", "one"), ("i1", "port", "3306"), ("i2", "hostname", "two"), ("i2", "port", "3307")]
    assert {(r.instance_id, r.error) for r in failed(rows).collect()} == {("i3", "OSError: no route to host"), ("i4", "OSError: gone away")}
    status = read_fleet(spark, servers[:2], "replica_status", connect, "2026-04-24 10:00:00", servers_per_task=2)
    assert status.rdd.getNumPartitions() == 1
    states = replica_status(spark.createDataFrame([("i1",), ("i3",)], "instance_id string"), answered(status)).collect()
    assert {(r.instance_id, r.is_replica, r.slave_io_running, r.seconds_behind_master) for r in states} == {("i1", True, "Yes", 3), ("i3", False, "", None)}


def test_growth_from_daily_bounds(spark):
    draw = random.Random(8)
    rows = [(f"i{draw.randrange(2)}", "s", f"d{draw.randrange(4)}", draw.randrange(100), draw.randrange(10**13),
             f"2026-0{m}-{d:02d} {h:02d}:00:00") for m in (3, 4) for d in range(1, 29, 3) for h in (0, 7, 23)]
    frame = spark.createDataFrame(rows, "instance_id string, schema_name string, digest string, exec_count long, sum_timer_wait long, timestamp string")
    path, folded = run_dir(spark, "bounds"), run_dir(spark, "folded")
    add_daily_bounds(frame.filter("digest != 'd1'"), path), add_daily_bounds(frame, path)  # some rows twice
    fold_daily_bounds(spark, path, folded)
    for since in ("2026-03-10", "2026-04-04 00:00:00", "2026-03-31 00:00:00", "2026-04-07 05:00:00"):
        want = Counter(counter_delta_fleet(frame, since).collect())
        for place in (path, folded):
            bounds = read_daily_bounds(spark, place)
            assert Counter(counter_delta_daily(bounds, since, frame).collect()) == want
    assert read_daily_bounds(spark, folded).count() < read_daily_bounds(spark, path).count()
    with pytest.raises(ValueError):
        counter_delta_daily(read_daily_bounds(spark, path), "2026-04-07 05:00:00")
    plan = counter_delta_daily(read_daily_bounds(spark, path), "2026-04-04 00:00:00")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and plan.count("FileScan") == 1
