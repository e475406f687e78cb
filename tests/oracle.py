"""Runs a registered query and its SQL over the same tables and compares the rows."""

import math
import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 4) + 0.0)
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    if isinstance(x, dict):
        return str({k: plain(v) for k, v in x.items()})
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, int):
        return repr(round(float(x), 4) + 0.0)
    return str(x)


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark, sf_dir, name, f, sql, con=None):
    """None if both give the same rows, else a short text."""
    df = f(spark, sf_dir)
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    got = (con or connect(sf_dir)).execute(sql)
    right = rows_of([d[0] for d in got.description], got.fetchall())
    if left[0] != right[0]:
        return f"{name}: columns {left[0]} and {right[0]}"
    if left[1] != right[1]:
        a = [x for x in left[1] if x not in set(right[1])][:2]
        b = [x for x in right[1] if x not in set(left[1])][:2]
        return f"{name}: {len(left[1])} and {len(right[1])} rows; only Spark {a}; only SQL {b}"
    return None
