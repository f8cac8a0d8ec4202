"""Runs a query and its SQL and compares them as sets of rows by column name."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in values), key=str)


def both(spark, con, query, sql, sf):
    frame = query(spark, sf)
    got = rows(frame.columns, [tuple(r) for r in frame.collect()])
    told = con.execute(sql)
    names = [d[0] for d in told.description]
    return sorted(frame.columns), sorted(names), got, rows(names, told.fetchall())
