"""Compares a query's rows with DuckDB's for its SQL."""

import datetime
import decimal
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def norm(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(round(v, 6))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


def agree(df, c, sql):
    cols = sorted(df.columns)
    got = Counter(repr(tuple(norm(r[x]) for x in cols)) for r in df.collect())
    found = c.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    at = [names.index(x) for x in cols]
    want = Counter(repr(tuple(norm(r[i]) for i in at)) for r in found.fetchall())
    assert got == want, (list((got - want))[:3], list((want - got))[:3])
