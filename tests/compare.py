"""Compare a registered Spark query with its oracle SQL on one data directory."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{os.path.join(folder, name)}.parquet')")
    return con


def normal(value):
    if value is None:
        return None
    if isinstance(value, bool) or isinstance(value, str):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, int):
        return value
    if hasattr(value, "as_tuple"):
        return float(value)
    return str(value)


def sort_key(row):
    return tuple((v is None, str(type(v).__name__), v if not isinstance(v, float) else round(v, 3)) for v in row)


def differences(con, df, sql: str, tolerance: float = 0.0, show: int = 5) -> list[str]:
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    want_rows = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return [f"columns differ: spark {sorted(df.columns)} oracle {sorted(names)}"]
    order = sorted(names)
    want = [tuple(normal(r[names.index(c)]) for c in order) for r in want_rows]
    got = [tuple(normal(r[c]) for c in order) for r in df.select(*order).collect()]
    problems = []
    if len(want) != len(got):
        problems.append(f"rows differ: spark {len(got)} oracle {len(want)}")
    want.sort(key=sort_key)
    got.sort(key=sort_key)
    for a, b in zip(got, want):
        for name, x, y in zip(order, a, b):
            if x == y and type(x) is type(y):
                continue
            if isinstance(x, float) and isinstance(y, float) and abs(x - y) <= tolerance:
                continue
            problems.append(f"{name}: spark {x!r} oracle {y!r} in {dict(zip(order, a))} vs {dict(zip(order, b))}")
            break
        if len(problems) >= show:
            break
    return problems
