"""Redundant indexes against a direct reading of the rule, and the table documents."""

import random
from collections import Counter, defaultdict

from fleetgauge import assemble_schemas, column_catalog, duplicate_indexes, index_catalog, schema_drift, table_catalog

STATISTICS = ("instance_id string, table_schema string, table_name string, index_name string, seq_in_index int, "
              "column_name string, non_unique int, index_type string")


def rows_of(indexes):
    """(instance, schema, table, index, columns, unique) to catalog rows."""
    return [(i, s, t, name, n, column, 0 if unique else 1, "BTREE")
            for i, s, t, name, columns, unique in indexes for n, column in enumerate(columns, 1)]


def by_reading(indexes):
    """Every pair of every table, as the rule is worded."""
    tables = defaultdict(list)
    for i, s, t, name, columns, unique in indexes:
        tables[i, s, t].append((name, columns, unique))
    found = Counter()
    for place, members in tables.items():
        members = sorted(members, key=lambda m: (len(m[1]), m[0]))
        for name, columns, unique in members:
            if name.upper() == "PRIMARY" or None in columns:
                continue
            for other, longer, other_unique in members:
                if other == name or len(longer) < len(columns) or None in longer[:len(columns)]:
                    continue
                if [c.lower() for c in longer[:len(columns)]] != [c.lower() for c in columns]:
                    continue
                if len(longer) == len(columns) and unique and not other_unique:
                    continue
                found[(*place, name, other, tuple(columns))] += 1
                break
    return found


def run(spark, indexes, **options):
    frame = duplicate_indexes(index_catalog(spark.createDataFrame(rows_of(indexes), STATISTICS)), **options)
    return Counter((r.instance_id, r.database, r.table, r.duplicate_index, r.overlaps_with, tuple(r.columns))
                   for r in frame.collect())


def test_small_cases(spark):
    def names(indexes, **options):
        return {(key[3], key[4]) for key in run(spark, [("i", "s", "t", *index) for index in indexes], **options)}
    assert names([("idx_email", ["email"], False), ("idx_email_name", ["email", "name"], False)]) == {("idx_email", "idx_email_name")}
    assert names([("PRIMARY", ["id"], True), ("by_id", ["id", "email"], False)]) == set()
    assert names([("PRIMARY", ["id", "x"], True), ("by_id", ["id"], False)]) == {("by_id", "PRIMARY")}
    assert names([("a", ["x"], False), ("b", ["X"], False)]) == {("a", "b"), ("b", "a")}
    assert names([("a", ["x"], False), ("b", ["X"], False)], keep_one=True) == {("b", "a")}
    assert names([("a", ["x"], True), ("b", ["x"], False)]) == {("b", "a")}
    assert names([("a", ["x"], True), ("b", ["x"], False), ("c", ["x", "y"], False)]) == {("a", "c"), ("b", "a")}
    assert names([("a", ["x"], True), ("b", ["x", "y"], False)]) == {("a", "b")}
    assert names([("a", ["x"], False)]) == set()


def test_random_tables(spark):
    draw = random.Random(11)
    indexes = []
    for table in range(300):
        for n in range(draw.randrange(1, 9)):
            name = "PRIMARY" if n == 0 and draw.random() < .7 else "primary" if n == 0 else f"k{draw.randrange(100)}_{n}"
            columns = [draw.choice(["a", "A", "b", "B", "c"]) for _ in range(draw.randrange(1, 4))]
            if draw.random() < .08:
                columns[draw.randrange(len(columns))] = None
            indexes.append((f"i{table % 3}", "s", f"t{table // 3}", name, columns, draw.random() < .3))
    assert run(spark, indexes) == by_reading(indexes)


def test_one_table_with_very_many_indexes(spark):
    draw = random.Random(2)
    indexes = [("i", "s", "t", f"k{n}", [draw.choice("ab") for _ in range(draw.randrange(1, 5))], n % 5 == 0) for n in range(400)]
    assert run(spark, indexes) == by_reading(indexes)


def test_statement_and_system_schemas(spark):
    indexes = [("i", s, "t", name, ["x"], False) for s in ("app", "mysql", "sys") for name in ("a", "b")]
    frame = duplicate_indexes(index_catalog(spark.createDataFrame(rows_of(indexes), STATISTICS)))
    assert {r.drop_statement for r in frame.collect()} == {
        "ALTER TABLE `app`.`t` DROP INDEX `a`;", "ALTER TABLE `app`.`t` DROP INDEX `b`;"}


def test_no_pairs_in_the_plan(spark):
    frame = duplicate_indexes(index_catalog(spark.createDataFrame([], STATISTICS)))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and not any(bad in plan for bad in ("Join", "Cartesian", "NestedLoop"))


def test_documents_take_one_shuffle_per_catalog(spark):
    plan = documents(spark, [column("a", 1)], [("i", "app", "t", "z", ["a"], False)])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange SinglePartition") <= 3


TABLES = ("instance_id string, table_schema string, table_name string, table_type string, table_rows long, data_length long, "
          "index_length long, engine string")
COLUMNS = ("instance_id string, table_schema string, table_name string, column_name string, ordinal_position int, data_type string, "
           "column_type string, is_nullable string, column_key string, extra string, column_default string, "
           "character_set_name string, collation_name string, column_comment string, generation_expression string")


def documents(spark, columns, indexes):
    tables = [("i", "app", "t", "BASE TABLE", None, 5, None, None), ("i", "app", "bare", "BASE TABLE", 1, 1, 1, "InnoDB"),
              ("i", "app", "v", "VIEW", None, None, None, None), ("i", "sys", "t", "BASE TABLE", 1, 1, 1, "InnoDB")]
    return assemble_schemas(
        table_catalog(spark.createDataFrame(tables, TABLES)), column_catalog(spark.createDataFrame(columns, COLUMNS)),
        index_catalog(spark.createDataFrame(rows_of(indexes), STATISTICS)))


def column(name, position, nullable="NO", default=None):
    return ("i", "app", "t", name, position, "int", "int unsigned", nullable, None, None, default, None, None, None, None)


def test_documents(spark):
    rows = {r.table_name: r for r in documents(
        spark, [column("b", 2, "YES"), column("a", 1, default="0")],
        [("i", "app", "t", "z", ["a", "b"], False), ("i", "app", "t", "PRIMARY", ["a"], True)]).collect()}
    assert set(rows) == {"t", "bare"}
    assert (rows["t"].table_rows, rows["t"].data_length, rows["t"].index_length, rows["t"].engine) == (0, 5, 0, "")
    assert [(c.name, c.position, c.is_nullable, c.default_value, c.column_key) for c in rows["t"].columns] == [
        ("a", 1, False, "0", ""), ("b", 2, True, None, "")]
    assert [(x.index_name, x.non_unique, x.columns) for x in rows["t"].indexes] == [
        ("PRIMARY", False, ["a"]), ("z", True, ["a", "b"])]
    assert rows["bare"].columns is None and rows["bare"].indexes is None


def test_drift(spark):
    before = documents(spark, [column("a", 1), column("b", 2)], [("i", "app", "t", "z", ["a"], False)])
    after = documents(spark, [column("a", 1, "YES"), column("c", 2)], [("i", "app", "t", "z", ["a"], False)])
    assert {(r.kind, r.name, r.change) for r in schema_drift(before, after).collect()} == {
        ("column", "a", "changed"), ("column", "b", "removed"), ("column", "c", "added")}
