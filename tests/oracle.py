"""Compare a query's rows with its SQL run by DuckDB over the same tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(d: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{d}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "is_nan") or type(v).__name__ == "Decimal":
        return int(v) if v == int(v) else float(v)
    return v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in values), key=repr)


def compare(spark, con, f, sql: str, d: str) -> str:
    """'' if both give the same columns and rows."""
    df = f(spark, d)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    want = rows(names, found.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    return "" if got == want else f"{len(got)} and {len(want)} rows, such as {[x for x in got if x not in want][:3]} and {[x for x in want if x not in got][:3]}"
