"""Run a registered query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET enable_progress_bar = false")
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def norm(value):
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    return value


def bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(norm(row[i]) for i in order) for row in rows)


def kinds(rows) -> list:
    return [sorted({type(v).__name__ for v in column if v is not None}) for column in zip(*rows)]


def differences(spark, sf_dir: str, function, sql: str, look=None) -> list[str]:
    frame = function(spark, sf_dir)
    if look:
        look(frame)
    got = [tuple(r) for r in frame.collect()]
    cursor = duck(sf_dir).execute(sql)
    names = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    out = []
    if sorted(frame.columns) != sorted(names):
        return [f"columns {sorted(frame.columns)} != {sorted(names)}"]
    if not want:
        out.append("no rows")
    if len(got) != len(want):
        out.append(f"rows {len(got)} != {len(want)}")
    a, b = bag(frame.columns, got), bag(names, want)
    if a != b:
        out.append(f"only in Spark: {list((a - b).items())[:3]}")
        out.append(f"only in SQL: {list((b - a).items())[:3]}")
    elif got:
        order = lambda cols, rows: [r for _, r in sorted(zip(cols, zip(*rows)))]
        for name, x, y in zip(sorted(names), order(frame.columns, got), order(names, want)):
            kx, ky = kinds([[v] for v in x[:50]])[0], kinds([[v] for v in y[:50]])[0]
            if kx != ky and kx and ky:
                out.append(f"types of {name}: {kx} != {ky}")
    return out
