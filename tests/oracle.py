"""Compare registered queries with their SQL in an independent engine.

``python tests/oracle.py [sf_dir] [name ...]``
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _cell(value: object) -> object:
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, (int, float)):
        return "nan" if math.isnan(value) else float(value) + 0.0
    return str(value)


def _rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=repr)


def differences(result: DataFrame, sql: str, connection: duckdb.DuckDBPyConnection) -> list[str]:
    """What differs between a Spark result and the SQL's; empty when they are equal."""
    mine = [tuple(row) for row in result.collect()]
    cursor = connection.execute(sql)
    names = [column[0] for column in cursor.description]
    theirs = cursor.fetchall()
    if sorted(names) != sorted(result.columns):
        return [f"columns {sorted(result.columns)} against {sorted(names)}"]
    found = []
    if len(mine) != len(theirs):
        found.append(f"{len(mine)} rows against {len(theirs)}")
    ours, other = _rows(result.columns, mine), _rows(names, theirs)
    unequal = [(a, b) for a, b in zip(ours, other) if a != b]
    found += [f"{str(a)[:300]} against {str(b)[:300]}" for a, b in unequal[:3]]
    if unequal:
        found.append(f"{len(unequal)} rows differ")
    return found


def main(sf_dir: str, names: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as contract
    from tests.session import session

    spark = session()
    connection = connect(sf_dir)
    failed = 0
    for name, query in contract.queries().items():
        if names and name not in names:
            continue
        begin = time.perf_counter()
        try:
            result = query(spark, sf_dir)
            sql = contract.oracle_sql().get(name)
            if sql is None:
                verdict = [f"rows only: {result.count()}"]
            else:
                verdict = differences(result, sql, connection)
                failed += bool(verdict)
        except Exception as error:  # report every query, whatever goes wrong in one
            verdict, failed = [f"{type(error).__name__}: {str(error)[:600]}"], failed + 1
        seconds = time.perf_counter() - begin
        print(f"{name:34} {seconds:6.1f}s  {'equal' if not verdict else verdict}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    arguments = sys.argv[1:]
    folder = arguments[0] if arguments else "/root/testdata/sf0.01"
    sys.exit(main(folder, arguments[1:]) > 0)
