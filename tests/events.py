"""Short ways to write events in tests."""

from __future__ import annotations

from datetime import datetime, timedelta

BASE = datetime(2026, 3, 9, 10)


def at(seconds=0.0, minutes=0):
    return BASE + timedelta(seconds=seconds, minutes=minutes)


def ev(kind, seconds=0.0, **more):
    return {"event_type": kind, "ts": at(seconds), **more}


def rows(n, seconds=0.0, name="shop.orders", operation="INSERT", txn="", **more):
    schema, _, table = name.partition(".")
    return ev("ROWS", seconds, schema=schema, table=table, operation=operation, row_count=n, txn_key=txn, **more)
