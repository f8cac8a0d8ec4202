import random

import pytest

from tests import model
from tests.events import at, ev, rows
from tidelog.operators import transactions as T
from tidelog.operators.normalize import complete
from tidelog.options import AnalysisOptions
from tidelog.plans.analyze import analyze_rows
from tidelog.schemas import EVENT

OFF = AnalysisOptions.unlimited()


def frame(spark, events):
    named = [{n: e.get(n) for n in EVENT.names} | {"seq": e.get("seq", k)} for k, e in enumerate(events)]
    return complete(spark.createDataFrame(named, EVENT))


def found(spark, events, run=3):
    txns = T.transactions(T.assign_transactions(frame(spark, events), run))
    return {r["txn_key"]: r for r in txns.collect()}, txns


B, X, C = (lambda s: ev("BEGIN", s)), (lambda s: ev("XID", s)), (lambda s: ev("COMMIT", s))

CASES = {
    "explicit": ([B(0), rows(2, 1), X(2)], [(2, 1, 0, 2)]),
    "implicit": ([rows(3, 0)], [(3, 1, 0, 0)]),
    "duration": ([B(0), rows(1, 5), X(10)], [(1, 1, 0, 10)]),
    "two": ([B(0), rows(2, 1), X(2), B(3), rows(3, 4), C(5)], [(2, 1, 0, 2), (3, 1, 3, 5)]),
    "commit only": ([B(0), rows(4, 1), C(2)], [(4, 1, 0, 2)]),
    "implicit closed by begin": ([rows(2, 5), B(10), rows(3, 11), X(12)], [(2, 1, 5, 5), (3, 1, 10, 12)]),
    "last left open": ([B(0), rows(5, 1), X(2), B(3), rows(3, 4)], [(5, 1, 0, 2), (3, 1, 3, 4)]),
    "orphans": ([X(0), C(1), rows(1, 2), X(3), X(4)], [(1, 1, 2, 2)]),
    "empty": ([B(0), X(9)], [(0, 0, 0, 9)]),
    "backwards": ([B(10), rows(1, 5), X(3)], [(1, 1, 10, 3)]),
    "nothing": ([], []),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    events, want = CASES[name]
    got, txns = found(spark, events)
    T.check_boundaries(txns)
    want = [(n, m, at(a), at(b), int((b - a) * 1000)) for n, m, a, b in want]
    assert [(r["total_rows"], r["event_count"], r["start_time"], r["end_time"], r["duration_ms"]) for _, r in sorted(got.items())] == want


def test_two_begins(spark):
    events = [B(0), rows(1, 1), X(2), rows(1, 3), B(4), rows(1, 5), B(6), X(7)]
    with pytest.raises(T.TransactionBoundaryError, match="BEGIN received while explicit transaction txn-3 is in-flight"):
        analyze_rows(spark, events, OFF)


def random_events(rng, n):
    out = []
    for k in range(n):
        kind = rng.choices(["BEGIN", "XID", "COMMIT", "ROWS", "ROWS_QUERY", "TABLE_MAP"], [2, 3, 1, 6, 2, 1])[0]
        s = rng.randint(0, 500)
        if kind == "ROWS":
            out.append(rows(rng.randint(0, 9), s, rng.choice(["a.x", "a.y", ".y", "a."]), rng.choice(["INSERT", "UPDATE", ""])))
        elif kind == "ROWS_QUERY":
            out.append(ev(kind, s, query_sql=rng.choice(["", "select 1", "  two\n words "]), query_original_bytes=5))
        else:
            out.append(ev(kind, s))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_against_the_state_machine(spark, seed):
    rng = random.Random(seed)
    events = random_events(rng, rng.choice([5, 30, 60]))
    events = [e | {"seq": 7 * k + (k > 20) * 1000} for k, e in enumerate(events)]
    try:
        want = model.transactions(events)
    except model.Boundary as error:
        with pytest.raises(T.TransactionBoundaryError) as raised:
            T.check_boundaries(found(spark, events, 30)[1])
        assert raised.value.number == error.number
        return
    assigned = T.assign_transactions(frame(spark, events).repartition(4), 30)
    txns = T.transactions(assigned)
    T.check_boundaries(txns)
    full = T.with_maps(txns, T.transaction_tables(assigned), T.transaction_operations(assigned)).collect()
    got = {r["txn_key"]: (r["start_time"], r["end_time"], r["total_rows"], r["event_count"], r["query_sql"], r["tables"], r["operations"]) for r in full}
    assert got == {t["key"]: (t["start"], t["end"], t["rows"], t["events"], t["sql"], t["tables"], t["operations"]) for t in want}


def test_maps_and_sql(spark):
    events = [B(0), rows(2, 1, "shop.orders"), ev("ROWS_QUERY", 1, query_sql="one", query_original_bytes=3), rows(1, 2, "shop.orders", "UPDATE"), rows(5, 3, "shop.users"), ev("ROWS_QUERY", 3, query_sql="SELECT   2\n\t", query_original_bytes=12), X(4)]
    r = analyze_rows(spark, events, OFF).transactions.first()
    assert (r["total_rows"], r["event_count"]) == (8, 3)
    assert r["tables"] == {"shop.orders": 3, "shop.users": 5} and r["operations"] == {"INSERT": 7, "UPDATE": 1}
    assert (r["query_sql"], r["query_summary"], r["query_original_bytes"]) == ("SELECT   2\n\t", "SELECT 2", 12)


def test_keys_order_as_text(spark):
    events = [e for k in range(11) for e in (B(k), rows(1, k), X(k))]
    got = analyze_rows(spark, events, AnalysisOptions.unlimited(top_transactions=3)).transactions.collect()
    assert [r["txn_key"] for r in got] == ["txn-1", "txn-10", "txn-11"]


def test_the_window_comes_first(spark):
    events = [B(0), rows(5, 15), rows(3, 45), X(90)]
    result = analyze_rows(spark, events, AnalysisOptions.unlimited(start=at(30), end=at(90)))
    s = result.summary.first()
    assert (s["total_transactions"], s["total_rows"], s["total_events"]) == (1, 3, 2)
    inclusive = analyze_rows(spark, [rows(1, 0), rows(2, 10), rows(3, 20), rows(4, 30)], AnalysisOptions.unlimited(start=at(10), end=at(20)))
    assert inclusive.summary.first()["total_rows"] == 5


def test_empty_input(spark):
    result = analyze_rows(spark, [], AnalysisOptions(detect_spikes=True))
    s = result.summary.first()
    assert (s["total_transactions"], s["total_rows"], s["total_events"], s["start_time"], s["duration_us"]) == (0, 0, 0, None, 0)
    assert result.tables.count() == result.transactions.count() == result.minutes.count() == result.alerts.count() == 0


def test_relational_tables(spark, tmp_path):
    from tidelog.schemas import RESULT_TABLES

    events = [B(0), ev("ROWS_QUERY", 0, query_sql="insert", query_original_bytes=6), rows(2000, 1), X(2)]
    result = analyze_rows(spark, events, AnalysisOptions())
    result.write_parquet(str(tmp_path / "out"))
    for name, schema in RESULT_TABLES.items():
        table = spark.read.parquet(str(tmp_path / "out" / name))
        assert [(f.name, f.dataType) for f in table.schema] == [(f.name, f.dataType) for f in schema]
        assert table.count() == 1
    result.release()


def test_reconstructed_keys(spark):
    from tidelog.options import TxnKeys

    events = [B(0), rows(1, 1), X(2), B(3), rows(1, 4), X(5), rows(1, 6)]
    plain = analyze_rows(spark, events, OFF).tables.first()
    built = analyze_rows(spark, events, AnalysisOptions.unlimited(txn_keys=TxnKeys.RECONSTRUCTED)).tables.first()
    assert (plain["txn_count"], built["txn_count"]) == (0, 3)


def test_events_are_sorted_by_runs_not_in_one_place(spark):
    plan = T.assign_transactions(frame(spark, [rows(1, k) for k in range(50)]), 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(run") >= 1


@pytest.mark.parametrize("run, stretch", [(1, 1), (2, 3), (7, 2), (64, 4096), (3, 0)])
def test_runs_in_stretches(spark, run, stretch):
    rng = random.Random(run * 31 + stretch)
    for _ in range(4):
        while True:
            events = random_events(rng, 60)
            try:
                want = model.transactions(events)
                break
            except model.Boundary:
                continue
        got = T.transactions(T.assign_transactions(frame(spark, events), run, stretch)).orderBy("txn_id").collect()
        assert [(r["txn_key"], r["start_time"], r["end_time"], r["total_rows"]) for r in got] == [(t["key"], t["start"], t["end"], t["rows"]) for t in want]
