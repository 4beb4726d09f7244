"""Compare a Spark result with what DuckDB returns for the SQL of the same query."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both agree, else what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    want = rows_of(names, result.fetchall())
    got = rows_of(df.columns, df.collect())
    if got == want:
        return ""
    only_got, only_want = got - want, want - got
    return (
        f"rows {sum(got.values())} and {sum(want.values())}; {sum(only_got.values())} only here, "
        f"{sum(only_want.values())} only in SQL; {list(only_got)[:2]} / {list(only_want)[:2]}"
    )
