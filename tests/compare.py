"""Compare a Spark result with the SQL result, values exactly."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return value if value is None or isinstance(value, int) else str(value)


def _rows(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(df, connection, sql: str) -> str | None:
    """None when equal, else a short description."""
    mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    theirs = _rows(names, result.fetchall())
    if mine == theirs:
        return None
    left, right = mine - theirs, theirs - mine
    return (
        f"columns {sorted(names)}; rows {sum(mine.values())} vs {sum(theirs.values())}; "
        f"only Spark {sum(left.values())} {list(left)[:2]}; only SQL {sum(right.values())} {list(right)[:2]}"
    )
