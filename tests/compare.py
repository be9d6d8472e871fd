"""Run a registered query and its SQL side by side and compare rows, names and types."""

import math
from decimal import Decimal

import duckdb

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


def connect(folder):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, Decimal):
        return float(value)
    return value


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=repr)


def differences(spark, connection, folder, build, sql):
    """None when both sides agree, else a short description."""
    frame = build(spark, folder)
    left = _sorted(frame.columns, [tuple(row) for row in frame.collect()])
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    right = _sorted(names, result.fetchall())
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}: {left[:2]} / {right[:2]}"
    if left != right:
        bad = [(a, b) for a, b in zip(left, right) if a != b]
        return f"{len(bad)} of {len(left)} rows differ, first {bad[0]}"
    kinds = {name: kind for name, kind in frame.dtypes}
    wanted = {column[0]: str(column[1]).lower() for column in result.description}
    loose = {"bigint": "bigint", "int": "integer", "double": "double", "string": "varchar", "date": "date",
             "timestamp": "timestamp", "boolean": "boolean"}
    wrong = {n: (k, wanted[n]) for n, k in kinds.items() if loose.get(k, k) != wanted[n]}
    return f"types {wrong}" if wrong else None
