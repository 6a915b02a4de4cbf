"""Runs a registered query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, bool) or value is None:
        return repr(value)
    return str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


_KINDS = {"bigint": "int", "int": "int", "integer": "int", "string": "str", "varchar": "str"}


def difference(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None when both give the same rows, else what differs."""
    df = query(spark, sf_dir)
    con.execute(sql)
    wanted_names = [c[0] for c in con.description]
    wanted_types = [str(c[1]).lower() for c in con.description]
    wanted = con.fetchall()
    got = [tuple(r) for r in df.collect()]
    plan = df._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "NestedLoopJoin"):
        if word in plan:
            return f"plan holds {word}"
    if sorted(df.columns) != sorted(wanted_names):
        return f"columns {sorted(df.columns)} != {sorted(wanted_names)}"
    kinds = lambda pairs: {n: _KINDS.get(t, t) for n, t in pairs}
    a, b = kinds(df.dtypes), kinds(zip(wanted_names, wanted_types))
    wrong = {n: (a[n], b[n]) for n in a if a[n] != b[n]}
    left, right = _rows(df.columns, got), _rows(wanted_names, wanted)
    if left != right:
        only = [r for r in left if r not in set(right)][:2]
        other = [r for r in right if r not in set(left)][:2]
        return f"{len(left)} rows vs {len(right)}; {sorted(df.columns)} spark only {only}, sql only {other}"
    return f"types {wrong}" if wrong else None
