"""The rule catalog: each rule fires and stays silent; Aurora, categories, user rules."""

import pytest
from pyspark.sql import functions as F

from fleetgauge import (
    CATEGORIES, RULES, by_severity, check_variables, findings_by_category, global_variables, rule, rule_context, rule_runs,
)

# (rule, variables that fire it, variables that do not). A text stands for the rule's own variable.
CASES = [
    ("innodb_buffer_pool_size", ["134217728"], ["8589934592", "", "128M"]),
    ("innodb_log_file_size", ["50331648"], ["268435456"]),
    ("innodb_data_file_path", ["ibdata1:12M:autoextend", "x:AUTOEXTEND"], ["ibdata1:10G", ""]),
    ("innodb_flush_method", ["fsync", "", {}], ["O_DIRECT", "o_direct"]),
    ("innodb_file_per_table", ["OFF", "off"], ["ON", ""]),
    ("innodb_flush_log_at_trx_commit", ["2", "0"], ["1", "", {}]),
    ("innodb_doublewrite", ["OFF"], ["ON"]),
    ("innodb_flush_neighbors", ["1"], ["0", ""]),
    ("innodb_io_capacity", ["200"], ["2000"]),
    ("innodb_io_capacity_max", ["2000"], ["10000"]),
    ("innodb_log_buffer_size", ["33554432"], ["16777216"]),
    ("innodb_force_recovery", ["1"], ["0", " 1"]),
    ("innodb_fast_shutdown", ["0", "2"], ["1", ""]),
    ("innodb_lock_wait_timeout", ["121"], ["120"]),
    ("innodb_dedicated_server", ["ON"], ["OFF"]),
    ("innodb_print_all_deadlocks", ["OFF"], ["ON"]),
    ("innodb_stats_persistent", ["OFF"], ["ON"]),
    ("innodb_checksum_algorithm", ["innodb"], ["crc32", "CRC32", ""]),
    ("innodb_redo_log_capacity",
     [{"version": "8.0.35", "innodb_redo_log_capacity": "104857600"}, {"version": "8.0.30", "innodb_redo_log_capacity": "104857600"}],
     [{"version": "8.0.28", "innodb_redo_log_capacity": "104857600"}, {"version": "8.0.35", "innodb_redo_log_capacity": "1"},
      {"innodb_redo_log_capacity": "104857600"}]),
    ("innodb_buffer_pool_instances",
     [{"innodb_buffer_pool_size": "2147483648", "innodb_buffer_pool_instances": "1"}],
     [{"innodb_buffer_pool_size": "1073741824", "innodb_buffer_pool_instances": "1"},
      {"innodb_buffer_pool_size": "2147483648", "innodb_buffer_pool_instances": "8"}, "1"]),
    ("expire_logs_days", [{"expire_logs_days": "0", "log_bin": "on"}],
     [{"expire_logs_days": "0", "log_bin": "OFF"}, {"expire_logs_days": "7", "log_bin": "ON"}, "0"]),
    ("log_bin", ["OFF"], ["ON", {}]),
    ("binlog_format", ["STATEMENT", "MIXED"], ["ROW", "row", ""]),
    ("sync_binlog", [{"sync_binlog": "0", "log_bin": "ON"}], [{"sync_binlog": "1", "log_bin": "ON"}, "0", {"log_bin": "ON"}]),
    ("gtid_mode", ["OFF", "ON_PERMISSIVE"], ["ON", ""]),
    ("enforce_gtid_consistency", [{"enforce_gtid_consistency": "WARN", "gtid_mode": "ON"}, {"gtid_mode": "ON"}],
     [{"enforce_gtid_consistency": "on", "gtid_mode": "ON"}, "OFF"]),
    ("binlog_row_image", [{"binlog_row_image": "FULL", "binlog_format": "ROW"}],
     [{"binlog_row_image": "MINIMAL", "binlog_format": "ROW"}, {"binlog_row_image": "FULL", "binlog_format": "MIXED"}]),
    ("replica_parallel_workers", ["0", "1", {"slave_parallel_workers": "0"}, {"replica_parallel_workers": "", "slave_parallel_workers": "1"}],
     ["4", {}, {"replica_parallel_workers": "4", "slave_parallel_workers": "0"}]),
    ("replica_preserve_commit_order",
     [{"replica_parallel_workers": "4", "replica_preserve_commit_order": "OFF"},
      {"slave_parallel_workers": "4", "slave_preserve_commit_order": "0"},
      {"replica_parallel_workers": "x", "slave_parallel_workers": "4", "slave_preserve_commit_order": "off"}],
     [{"replica_parallel_workers": "1", "replica_preserve_commit_order": "OFF"}, "OFF",
      {"replica_parallel_workers": "4", "replica_preserve_commit_order": "ON", "slave_preserve_commit_order": "OFF"}]),
    ("binlog_transaction_dependency_tracking", ["COMMIT_ORDER"], ["WRITESET", ""]),
    ("binlog_expire_logs_seconds", [{"binlog_expire_logs_seconds": "0", "log_bin": "ON"}], ["0", {"log_bin": "ON"}]),
    ("log_replica_updates", ["OFF", {"log_slave_updates": "off"}], ["ON", {"log_replica_updates": "ON", "log_slave_updates": "OFF"}]),
    ("innodb_autoinc_lock_mode", [{"innodb_autoinc_lock_mode": "1", "binlog_format": "ROW"}],
     [{"innodb_autoinc_lock_mode": "2", "binlog_format": "ROW"}, "1"]),
    ("replica_skip_errors", ["1062", "all", {"slave_skip_errors": "1032"}], ["OFF", "off", "0", {}, ""]),
    ("binlog_cache_size", ["32768"], ["524288"]),
    ("max_connections", ["1001", "6000"], ["1000"]),
    ("max_connections_critical", [{"max_connections": "5001"}], [{"max_connections": "5000"}]),
    ("thread_cache_size", ["0"], ["16", {}]),
    ("wait_timeout_high", [{"wait_timeout": "28801"}], [{"wait_timeout": "28800"}]),
    ("wait_timeout_low", [{"wait_timeout": "59"}], [{"wait_timeout": "60"}]),
    ("interactive_timeout", [{"interactive_timeout": "1", "wait_timeout": "01"}, {"interactive_timeout": "", "wait_timeout": "1"}],
     [{"interactive_timeout": "1", "wait_timeout": "1"}, "1", {"wait_timeout": "1"}]),
    ("max_connect_errors", ["100", "-1"], ["100000"]),
    ("connect_timeout", ["31"], ["30"]),
    ("max_allowed_packet", ["4194304"], ["67108864"]),
    ("sort_buffer_size", ["524288"], ["262144", "x"]),
    ("sort_buffer_size_large", [{"sort_buffer_size": "2097153"}], [{"sort_buffer_size": "2097152"}]),
    ("key_buffer_size", ["8388608"], ["16777216"]),
    ("join_buffer_size", ["4194305"], ["4194304"]),
    ("read_buffer_size", ["8388609"], ["8388608"]),
    ("read_rnd_buffer_size", ["4194305"], ["4194304"]),
    ("tmp_table_size_mismatch", [{"tmp_table_size": "2", "max_heap_table_size": "1"}],
     [{"tmp_table_size": "1", "max_heap_table_size": "1"}, {"tmp_table_size": "2"}]),
    ("tmp_table_size_large", [{"tmp_table_size": "268435457"}], [{"tmp_table_size": "268435456"}]),
    ("max_heap_table_size", [{"tmp_table_size": "2", "max_heap_table_size": "1"}], ["1"]),
    ("bulk_insert_buffer_size", ["67108865"], ["67108864", "99999999999999999999"]),
    ("local_infile", ["ON"], ["OFF"]),
    ("skip_name_resolve", ["OFF"], ["ON"]),
    ("require_secure_transport", ["OFF"], ["ON"]),
    ("sql_mode_strict", [{"sql_mode": "ANSI"}], [{"sql_mode": "strict_trans_tables"}, {"sql_mode": ""}, {}]),
    ("sql_mode_no_engine_sub", [{"sql_mode": "ANSI"}], [{"sql_mode": "NO_ENGINE_SUBSTITUTION,ANSI"}, {"sql_mode": ""}]),
    ("default_authentication_plugin",
     ["mysql_native_password", {"authentication_policy": "mysql_native_password,,"},
      {"authentication_policy": " sha256_password ,*", "default_authentication_plugin": "caching_sha2_password"}],
     ["caching_sha2_password", {"authentication_policy": "*,,", "default_authentication_plugin": "mysql_native_password"},
      {"authentication_policy": "Caching_SHA2_password"}, ""]),
    ("tls_version", ["TLSv1.1,TLSv1.2", "TLSv1", "TLSv1.2, TLSv1"], ["TLSv1.2,TLSv1.3", "tlsv1", ""]),
    ("performance_schema", ["OFF"], ["ON"]),
    ("delay_key_write", ["ON"], ["OFF", "ALL"]),
    ("myisam_recover_options", ["OFF"], ["BACKUP,FORCE"]),
    ("table_open_cache", ["3999"], ["4000"]),
    ("table_definition_cache", ["1999"], ["2000"]),
    ("open_files_limit", ["65534"], ["65535"]),
    ("log_output", ["TABLE"], ["FILE", "FILE,TABLE"]),
    ("character_set_server", ["latin1"], ["utf8mb4", "UTF8MB4", ""]),
    ("default_storage_engine", ["MyISAM"], ["innodb", ""]),
    ("slow_query_log", ["OFF"], ["ON"]),
    ("long_query_time", ["11"], ["10", "20.000000"]),
]


def snapshots(spark, variables):
    """Servers named by their place in the list; a server without variables still has a version."""
    rows = [(str(i), name, value) for i, given in enumerate(variables) for name, value in ({"version": "", **given}).items()]
    return spark.createDataFrame(rows, "instance_id string, variable_name string, variable_value string")


@pytest.fixture(scope="module")
def verdicts(spark):
    flat = [(name, given if isinstance(given, dict) else {name: given}, fires)
            for name, firing, silent in CASES for fires, group in ((True, firing), (False, silent)) for given in group]
    found = check_variables(snapshots(spark, [given for _, given, _ in flat])).collect()
    by_server = {}
    for row in found:
        by_server.setdefault(int(row.instance_id), {})[row.rule_id] = row
    return [(name, given, fires, by_server.get(i, {}).get(name)) for i, (name, given, fires) in enumerate(flat)]


def test_every_rule_fires_and_stays_silent(verdicts):
    wrong = [(name, given, fires) for name, given, fires, row in verdicts if (row is not None) != fires]
    assert wrong == []
    assert {case[0] for case in CASES} == {rule.id for rule in RULES}


def test_reported_value_is_the_raw_text(verdicts):
    for _, given, fires, row in verdicts:
        if fires:
            assert row.current_value == given.get(row.variable, "")


def test_renamed_variables_report_the_name_used(verdicts):
    shown = {(row.rule_id, row.variable) for _, _, fires, row in verdicts if fires}
    for new, old in (("replica_parallel_workers", "slave_parallel_workers"),
                     ("replica_preserve_commit_order", "slave_preserve_commit_order"),
                     ("log_replica_updates", "log_slave_updates"), ("replica_skip_errors", "slave_skip_errors"),
                     ("default_authentication_plugin", "authentication_policy")):
        assert {(new, new), (new, old)} <= shown


def test_catalog():
    assert len(RULES) == 72
    assert len({rule.id for rule in RULES}) == 72
    assert [c for c in CATEGORIES] == list(dict.fromkeys(rule.category for rule in RULES))
    sizes = [sum(rule.category == c for rule in RULES) for c in CATEGORIES]
    assert sizes == [20, 15, 9, 10, 7, 1, 10]
    tagged = {tag: {rule.id for rule in RULES if tag in rule.tags} for tag in ("aurora-skip", "aurora-downgrade", "myisam-only")}
    assert len(tagged["aurora-skip"]) == 14
    assert tagged["aurora-downgrade"] == {"innodb_flush_log_at_trx_commit", "log_bin", "gtid_mode", "log_replica_updates"}
    assert tagged["myisam-only"] == {"delay_key_write", "myisam_recover_options", "key_buffer_size"}
    assert tagged["myisam-only"] <= tagged["aurora-skip"]
    critical = {rule.id for rule in RULES if rule.severity == "critical"}
    assert critical == {"max_connections_critical", "replica_skip_errors"}


def test_aurora(spark):
    given = {"innodb_flush_method": "fsync", "gtid_mode": "OFF", "max_connections": "9999", "binlog_format": "MIXED"}
    rows = snapshots(spark, [given, {**given, "aurora_version": ""}])
    found = {(r.instance_id, r.rule_id): r.severity for r in check_variables(rows).collect()}
    assert found[("0", "gtid_mode")] == "warn" and found[("1", "gtid_mode")] == "note"
    assert found[("1", "max_connections_critical")] == "critical" and found[("1", "binlog_format")] == "warn"
    assert ("0", "innodb_flush_method") in found and ("1", "innodb_flush_method") not in found
    runs = {r.instance_id: (r.is_aurora, r.total_rules, r.rules_skipped) for r in rule_runs(rows).collect()}
    assert runs == {"0": (False, 72, 0), "1": (True, 72, 14)}
    one = {r.instance_id: (r.total_rules, r.rules_skipped) for r in rule_runs(rows, category="memory").collect()}
    assert one == {"0": (72, 0), "1": (72, 1)}


def test_category(spark):
    rows = snapshots(spark, [{"log_bin": "OFF", "local_infile": "ON"}])
    assert {r.rule_id for r in check_variables(rows, category="security").collect()} == {"local_infile"}
    nothing = check_variables(rows, category="no such")
    assert nothing.collect() == [] and nothing.columns == check_variables(rows).columns


def test_order_and_groups(spark):
    rows = snapshots(spark, [{"max_connections": "6000", "log_bin": "OFF", "innodb_flush_method": "O_DIRECT",
                              "long_query_time": "99", "local_infile": "ON"}])
    found = check_variables(rows)
    assert [r.rule_id for r in by_severity(found).collect()] == [
        "max_connections_critical", "log_bin", "local_infile", "max_connections", "long_query_time"]
    groups = {r.category: [f.rule_id for f in r.findings] for r in findings_by_category(found).collect()}
    assert groups["connections"] == ["max_connections", "max_connections_critical"]


def test_names_fold_and_later_duplicates_win(spark):
    rows = spark.createDataFrame(
        [("a", 1, "Max_Connections", "10"), ("a", 2, "max_connections", "2000"), ("a", 1, "LOG_BIN", "ON")],
        "instance_id string, seq int, variable_name string, variable_value string")
    assert rows.transform(lambda d: global_variables(d, seq="seq")).first().vars == {"max_connections": "2000", "log_bin": "ON"}
    assert [r.rule_id for r in check_variables(rows, seq="seq").filter("category = 'connections'").collect()] == ["max_connections"]


def test_from_maps_and_user_rules(spark):
    maps = global_variables(snapshots(spark, [{"port": "3306", "log_bin": "OFF"}]))
    mine = rule("port", "custom", "note", "{int.port} = 3306", "The well-known port.")
    found = check_variables(maps, [*RULES, mine]).filter(F.col("category").isin("custom", "replication"))
    assert {(r.rule_id, r.ordinal) for r in found.collect()} == {("log_bin", 21), ("port", 72)}
    context = rule_context(maps, [mine]).first()
    assert context.int_port == 3306 and context.is_aurora is False


def test_server_without_any_named_variable_is_still_checked(spark):
    rows = spark.createDataFrame([("a", "unknown_thing", "1")], "instance_id string, variable_name string, variable_value string")
    assert [r.rule_id for r in check_variables(rows).collect()] == ["innodb_flush_method"]


def test_two_shuffles_and_no_join(spark):
    plan = check_variables(snapshots(spark, [{}]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Join" not in plan and "Python" not in plan
