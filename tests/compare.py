"""Runs queries and their SQL twins side by side: python tests/compare.py FOLDER [QUERY ...]"""

from __future__ import annotations

import collections
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(folder: str):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def _value(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    return value


def _bag(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return collections.Counter(tuple(_value(row[i]) for i in order) for row in rows)


def difference(connection, sql: str, frame) -> str | None:
    """None when both hold the same rows under the same names, else what differs."""
    cursor = connection.execute(sql)
    names = [column[0] for column in cursor.description]
    expected = cursor.fetchall()
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} against {sorted(names)}"
    got, want = _bag(frame.collect(), frame.columns), _bag(expected, names)
    if got == want:
        return None
    return (f"{sum(got.values())} rows against {sum(want.values())}; "
            f"only in Spark {list((got - want).items())[:2]}; only in SQL {list((want - got).items())[:2]}")


def main(folder: str, chosen: list[str]) -> int:
    import __spark_entry__ as entry
    from fleetgauge import build_session
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    connection, failed = duck(folder), 0
    queries, twins = entry.queries(), entry.oracle_sql()
    for name in chosen or queries:
        start = time.time()
        try:
            frame = queries[name](spark, folder)
            found = difference(connection, twins[name], frame) if name in twins else f"no SQL, {frame.count()} rows"
        except Exception as error:  # noqa: BLE001
            found = f"{type(error).__name__}: {str(error)[:700]}"
        failed += found is not None
        print(f"{name:24s}{time.time() - start:7.2f}s  {found or 'same'}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
