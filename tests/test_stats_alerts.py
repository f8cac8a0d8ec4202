import random
from datetime import timedelta

import pytest

from tests import model
from tests.events import at, ev, rows
from tidelog.options import AnalysisOptions
from tidelog.plans.analyze import analyze_rows

OFF = AnalysisOptions.unlimited()
M = 60


def tables(spark, events, **options):
    out = analyze_rows(spark, events, AnalysisOptions.unlimited(**options)).tables.collect()
    return [(f"{r['schema']}.{r['table']}", r["total_rows"], r["insert_rows"], r["update_rows"], r["delete_rows"], r["txn_count"]) for r in out]


def minutes(spark, events):
    return [(r["minute"], r["total_rows"], r["txn_count"], r["table_rows"]) for r in analyze_rows(spark, events, OFF).minutes.collect()]


def test_operations_and_distinct_transactions(spark):
    events = [rows(2, txn="t1"), rows(1, operation="UPDATE", txn="t1")]
    assert tables(spark, events) == [("shop.orders", 3, 2, 1, 0, 1)]
    events = [rows(5, txn="t1"), rows(3, name="shop.users", txn="t1"), rows(2, operation="DELETE", txn="t2")]
    assert tables(spark, events) == [("shop.orders", 7, 5, 0, 2, 2), ("shop.users", 3, 3, 0, 0, 1)]


def test_order_and_limit(spark):
    events = [rows(1, name="shop.zebra"), rows(1, name="app.alpha"), rows(1, name="shop.apple")]
    assert [t[0] for t in tables(spark, events)] == ["app.alpha", "shop.apple", "shop.zebra"]
    events = [rows(5, name="s.a"), rows(100, name="s.b"), rows(50, name="s.c")]
    assert [t[1] for t in tables(spark, events, top_tables=2)] == [100, 50]


def test_what_counts(spark):
    named = {"schema": "shop", "table": "orders", "row_count": 5}
    others = [ev("TABLE_MAP", **named), ev("BEGIN", **named), ev("COMMIT", **named), ev("XID", **named), ev("ROWS", operation="", **named)]
    assert tables(spark, others) == []
    assert tables(spark, [rows(0)]) == [("shop.orders", 0, 0, 0, 0, 0)] and minutes(spark, [rows(0)]) == []
    assert tables(spark, [rows(3, name=".t"), rows(3, name="s.")]) == [] == minutes(spark, [rows(3, name=".t"), rows(3, name="s.")])


def test_minutes(spark):
    events = [rows(5, txn="t1"), rows(3, 20, "shop.users", txn="t1"), rows(2, 59, txn="t2")]
    assert minutes(spark, events) == [(at(), 10, 2, {"shop.orders": 7, "shop.users": 3})]
    events = [rows(1, 2 * M), rows(2, 0), rows(3, M), rows(4, 2 * M + 30)]
    assert [(m, n) for m, n, _, _ in minutes(spark, events)] == [(at(), 2), (at(M), 3), (at(2 * M), 5)]


def alerts(spark, events, **options):
    return analyze_rows(spark, events, AnalysisOptions.unlimited(**options)).alerts.collect()


def series(*totals, name="s.t"):
    return [rows(n, M * k, name) for k, n in enumerate(totals) if n]


SPIKES = [
    ((10, 12, 120), 2, 5, 50, [(2, 120, 11)]),
    ((10, 12, 120), 2, 5, 200, []),
    ((10, 100, 500), 2, 5, 100, [(2, 500, 55)]),
    ((10, 12, 50), 2, 10, 20, []),
    ((10, 10, 100, 10, 10, 300), 2, 5, 50, [(2, 100, 10), (5, 300, 10)]),
    ((10, 500), 2, 5, 50, []),
    ((10, 0, 0, 12, 120), 2, 5, 50, [(4, 120, 11)]),
]


@pytest.mark.parametrize("totals,window,factor,least,want", SPIKES)
def test_spikes(spark, totals, window, factor, least, want):
    got = alerts(spark, series(*totals), detect_spikes=True, spike_window=window, spike_factor=factor, spike_min_rows=least)
    overall = [(r["minute"], r["rows"], r["baseline"]) for r in got if r["table"] is None]
    assert overall == [(at(M * k), n, b) for k, n, b in want]
    assert all(r["factor"] == r["rows"] / r["baseline"] and r["severity"] == "warning" for r in got)
    assert alerts(spark, series(*totals), spike_window=window, spike_factor=factor, spike_min_rows=least) == []
    assert alerts(spark, series(*totals), detect_spikes=True, spike_window=0, spike_factor=factor, spike_min_rows=least) == []


def test_table_spikes(spark):
    settings = {"detect_spikes": True, "spike_window": 2, "spike_factor": 5.0, "spike_min_rows": 50}
    both = series(10, 10, 100, name="shop.orders") + series(10, 10, 10, name="shop.users")
    got = [(r["table"], r["rows"], r["baseline"]) for r in alerts(spark, both, **settings)]
    assert got == [("shop.orders", 100, 10), (None, 110, 20)]
    flat = series(10, 10, 90, name="shop.orders") + series(90, 90, 10, name="shop.users")
    assert [r["table"] for r in alerts(spark, flat, **settings)] == ["shop.orders"]
    three = [e for n in ("s.zebra", "s.alpha", "s.beta") for e in series(10, 10, 100, name=n)]
    assert [r["table"] for r in alerts(spark, three, **settings)] == ["s.alpha", "s.beta", "s.zebra", None]


@pytest.mark.parametrize("seed", range(6))
def test_spikes_against_the_model(spark, seed):
    rng = random.Random(seed)
    events = [rows(rng.choice([1, 3, 20, 60, 200]), M * rng.randint(0, 40), f"s.t{rng.randint(0, 3)}") for _ in range(90)]
    per = {}
    for e in events:
        tables = per.setdefault(e["ts"], {})
        k = f"s.{e['table']}"
        tables[k] = tables.get(k, 0) + e["row_count"]
    buckets = [(m, sum(t.values()), t) for m, t in sorted(per.items())]
    window, factor, least = rng.choice([1, 2, 4, 5]), rng.choice([1.5, 3.0]), rng.choice([1, 30])
    got = alerts(spark, events, detect_spikes=True, spike_window=window, spike_factor=factor, spike_min_rows=least)
    assert sorted(((r["minute"], r["table"] or "", r["rows"], r["baseline"]) for r in got)) == sorted((m, t or "", n, b) for m, t, n, b in model.spikes(buckets, window, factor, least))


def txn(n, start, end, names=("s.t",)):
    return [ev("BEGIN", start), *(rows(n if k == 0 else 1, start, name) for k, name in enumerate(names)), ev("XID", end)]


def test_large_transactions(spark):
    events = txn(100, 0, 1) + txn(1500, 2, 62, ("s.zebra", "s.alpha", "s.middle", "s.beta")) + txn(1000, 70, 100)
    by_rows = alerts(spark, events, large_txn_rows=1000)
    assert [(r["txn_key"], r["rows"], r["rows_threshold"], r["duration_threshold_ms"]) for r in by_rows] == [("txn-2", 1503, 1000, None)]
    assert by_rows[0]["tables"] == ["s.alpha", "s.beta", "s.middle", "s.zebra"]
    assert by_rows[0]["message"] == "Transaction txn-2 exceeds row threshold"
    by_time = alerts(spark, events, large_txn_duration=timedelta(seconds=30))
    assert [(r["txn_key"], r["duration_ms"], r["rows_threshold"], r["message"]) for r in by_time] == [("txn-2", 60000, None, "Transaction txn-2 exceeds duration threshold")]
    one = alerts(spark, events, large_txn_rows=1000, large_txn_duration=timedelta(seconds=30))
    assert [r["message"] for r in one] == ["Transaction txn-2 exceeds row threshold and exceeds duration threshold"]
    assert alerts(spark, events) == []


def test_persistence_fixture(spark):
    events = [e for k, n in enumerate((10, 12, 60, 80)) for e in (ev("BEGIN", M * k), rows(n, M * k + 1), ev("XID", M * k + 2))]
    options = {"top_tables": 2, "top_transactions": 2, "detect_spikes": True, "spike_window": 2, "spike_factor": 3.0, "spike_min_rows": 10, "large_txn_rows": 50}
    result = analyze_rows(spark, events, AnalysisOptions.unlimited(**options))
    assert [r["txn_key"] for r in result.transactions.collect()] == ["txn-4", "txn-3"]
    got = [(r["type"], r["txn_key"], r["table"], r["baseline"]) for r in result.alerts.collect()]
    assert got == [("large_transaction", "txn-3", None, None), ("large_transaction", "txn-4", None, None), ("spike", "", "shop.orders", 11), ("spike", "", None, 11)]


def test_spike_heavy_fixture(spark):
    heavy = [180 if k % 30 == 0 or k % 31 == 0 else 12 for k in range(180)]
    result = analyze_rows(spark, series(*heavy), AnalysisOptions(detect_spikes=True))
    found = [r for r in result.alerts.collect() if r["type"] == "spike"]
    want = [30, 31, 60, 62, 90, 93, 120, 124, 150, 155]
    assert [r["minute"] for r in found if r["table"] is None] == [at(M * k) for k in want] == [r["minute"] for r in found if r["table"]]
    assert {r["baseline"] for r in found} == {12}
