"""Comparing a Spark result with DuckDB's, values and types."""

from __future__ import annotations

import math
from collections import Counter
from datetime import date, datetime

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, (str, int)):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}") + 0.0
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, date):
        return value.isoformat()
    return f"{type(value).__name__}:{value}"


def _kind(name: str) -> str:
    name = name.lower()
    same = {"timestamp_ntz": "timestamp", "varchar": "string", "integer": "int", "float64": "double"}
    return same.get(name, name)


def differences(df, con, sql: str) -> list[str]:
    """What differs between the two results; empty when they agree."""
    relation = con.sql(sql)
    theirs = dict(zip(relation.columns, (_kind(str(t)) for t in relation.types)))
    ours = {f.name: _kind(f.dataType.simpleString()) for f in df.schema.fields}
    if theirs != ours:
        odd = set(theirs.items()) ^ set(ours.items())
        return [f"columns differ: {sorted(odd)}"]
    order = sorted(ours)
    left = Counter(tuple(_plain(r[c]) for c in order) for r in df.collect())
    place = [relation.columns.index(c) for c in order]
    right = Counter(tuple(_plain(r[i]) for i in place) for r in relation.fetchall())
    if left == right:
        return [] if left else ["both are empty"]
    extra, missing = left - right, right - left
    return [
        f"{sum(left.values())} rows against {sum(right.values())}; columns {order}",
        *(f"only Spark: {r}" for r in list(extra)[:3]),
        *(f"only SQL: {r}" for r in list(missing)[:3]),
    ]
