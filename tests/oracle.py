"""Run a registered query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _rows(names, rows):
    """Columns by name, rows sorted by their exact cells first and their floats last."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    cleaned = [
        tuple(None if isinstance(row[i], float) and math.isnan(row[i]) else row[i] for i in order) for row in rows
    ]

    def key(row):
        exact = [str(x) for x in row if not isinstance(x, float)]
        return exact, [x for x in row if isinstance(x, float)]

    return [names[i] for i in order], sorted(cleaned, key=key)


def _differ(x, y, atol):
    if isinstance(x, float) and isinstance(y, float):
        return not (x == y or abs(x - y) <= atol)
    return str(x) != str(y)


def compare(spark, con, name, plan, sql, sf_dir, atol=0.0) -> str | None:
    """None when equal, else a description of the first difference."""
    df = plan(spark, sf_dir)
    names, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_names, want = _rows([d[0] for d in cur.description], cur.fetchall())
    if names != want_names:
        return f"columns {names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows, SQL has {len(want)}"
    for a, b in zip(got, want):
        for c, x, y in zip(names, a, b):
            if _differ(x, y, atol):
                return f"{c}: {x!r} != {y!r} in {a} / {b}"
    return None
