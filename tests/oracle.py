"""Compares a query's rows with those of its SQL."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return db


def _plain(v):
    if isinstance(v, float):
        return repr(round(v, 9)) if math.isfinite(v) else str(v)
    return repr(v)


def assert_same(df, db, sql):
    names = sorted(df.columns)
    got = sorted(tuple(_plain(r[c]) for c in names) for r in df.collect())
    out = db.execute(sql)
    have = [d[0] for d in out.description]
    assert sorted(have) == names
    at = [have.index(c) for c in names]
    want = sorted(tuple(_plain(r[i]) for i in at) for r in out.fetchall())
    assert got == want
