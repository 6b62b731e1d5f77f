"""Runs a registered query in Spark and its SQL in DuckDB and compares columns, types and rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _value(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~null"
    if isinstance(value, float):
        return f"{value:.6f}"
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_value(row[i]) for i in order) for row in rows)


_KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
          "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


def differences(df, con, sql: str) -> list[str]:
    result = con.sql(sql)
    expected_types = dict(zip(result.columns, map(str, result.types)))
    found_types = {name: _KINDS.get(kind, kind) for name, kind in df.dtypes}
    problems = []
    if expected_types != found_types:
        problems.append(f"types {found_types} != {expected_types}")
    found = rows_of(df.columns, df.collect())
    expected = rows_of(result.columns, result.fetchall())
    if len(found) != len(expected):
        problems.append(f"{len(found)} rows != {len(expected)}")
    wrong = [(a, b) for a, b in zip(found, expected) if a != b]
    if wrong:
        problems.append(f"{len(wrong)} rows differ, first {wrong[0]}")
    return problems
