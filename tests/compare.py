"""Compare a Spark result with DuckDB's on the same tables."""

from __future__ import annotations

import glob
import os
from decimal import Decimal

import duckdb
from pyspark.sql import DataFrame

KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "tinyint": "TINYINT", "double": "DOUBLE", "float": "FLOAT",
    "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Differences in columns, types, row count and values; empty when equal."""
    cursor = con.execute(sql)
    described = {d[0]: str(d[1]) for d in cursor.description}
    expected = cursor.fetchall()
    names = [d[0] for d in cursor.description]
    problems = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    for name, kind in df.dtypes:
        if KINDS.get(kind, kind) != described[name]:
            problems.append(f"type of {name}: {kind} != {described[name]}")
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    want = rows_of(expected, names)
    if len(got) != len(want):
        problems.append(f"{len(got)} rows != {len(want)}")
    if got != want:
        extra = sorted(set(got) - set(want), key=repr)[:3]
        lost = sorted(set(want) - set(got), key=repr)[:3]
        problems.append(f"values differ, only in Spark {extra}, only in SQL {lost}")
    return problems
