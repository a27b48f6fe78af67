"""Compares a query's rows with those of SQL that DuckDB runs on the same tables."""

from __future__ import annotations

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def assert_same(df, sql: str, sf: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    columns = sorted(names)
    theirs = sorted((tuple(_plain(dict(zip(names, r))[c]) for c in columns) for r in got.fetchall()), key=repr)
    ours = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert len(ours) == len(theirs)
    assert ours == theirs
