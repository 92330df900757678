"""Runs SQL on the driver tables and compares rows without regard to order."""

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return repr([norm(x) for x in v])
    return repr(v)


def same(df, connection, sql):
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    want = sorted(tuple(norm(dict(zip(names, r, strict=True))[c]) for c in columns) for r in cursor.fetchall())
    assert sorted(names) == columns
    assert got == want
    return len(got)
