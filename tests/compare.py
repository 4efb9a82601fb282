"""Compares a query's rows with those of its SQL, without regard to order."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

DATA = Path("/root/testdata")


def connect(d: Path):
    import duckdb

    con = duckdb.connect()
    for p in d.iterdir():
        con.execute(f"CREATE VIEW {p.name.removesuffix('.parquet')} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return round(float(v), 5)
    return str(v)


def rows(columns, data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def same(spark, query, sql: str, d: Path) -> None:
    df = query(spark, str(d))
    got = rows(df.columns, df.collect())
    out = connect(d).execute(sql)
    names = [c[0] for c in out.description]
    assert sorted(df.columns) == sorted(names)
    want = rows(names, out.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
