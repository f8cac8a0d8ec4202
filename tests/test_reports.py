import io
import json
from datetime import datetime

import pytest

from tests.events import at, ev, rows
from tidelog import cli
from tidelog.options import AnalysisOptions, SqlContext, parse_duration, parse_time, parse_time_range
from tidelog.plans.analyze import analyze_rows
from tidelog.reports import render as R
from tidelog.reports import values as V
from tidelog.schemas import RAW_EVENT

SQL = "INSERT INTO   t VALUES ('<a> & b')"


@pytest.fixture(scope="module")
def result(spark):
    events = [ev("BEGIN", 0), ev("ROWS_QUERY", 0, query_sql=SQL, query_original_bytes=len(SQL)), rows(1500, 1, txn="t1"), ev("XID", 2.5)]
    events += [ev("BEGIN", 61), rows(3, 62, "shop.users", "UPDATE", "t2"), ev("COMMIT", 961)]
    return R.collected(analyze_rows(spark, events, AnalysisOptions()))


def test_text(result):
    assert R.text_of(result) == """=== Workload Summary ===
  Total Transactions: 2
  Total Rows: 1503
  Total Events: 7
  Time Range: 2026-03-09 10:00:00 - 2026-03-09 10:16:01
  Duration: 16m1s

=== Top Tables ===
  shop.orders: 1500 rows (1500 insert, 0 update, 0 delete, 1 txn)
  shop.users: 3 rows (0 insert, 3 update, 0 delete, 1 txn)

=== Top Transactions ===
  txn-1: 1500 rows in 2.5s (1 events)
    Query: INSERT INTO t VALUES ('<a> & b')
  txn-2: 3 rows in 15m0s (1 events)

=== Minute Activity ===
  2026-03-09 10:00: 1500 rows, 1 txn
  2026-03-09 10:01: 3 rows, 1 txn

=== Alerts ===
  [WARNING] large_transaction: Transaction txn-1 exceeds row threshold
  [WARNING] large_transaction: Transaction txn-2 exceeds duration threshold

"""
    assert f"    Query: {SQL}\n" in R.text_of(result, "full")
    assert "Query:" not in R.text_of(result, SqlContext.OFF)
    assert R.text_of(result, "nonsense") == R.text_of(result)


def test_empty_text(spark):
    text = R.render_text(analyze_rows(spark, []))
    assert "Time Range: N/A - N/A" in text and "Duration: 0s" in text
    for line in ("(no table activity)", "(no transactions)", "(no minute activity)", "(no alerts)"):
        assert f"  {line}\n" in text


def test_json(result):
    text = R.json_of(result)
    told = json.loads(text)
    assert text.startswith('{\n  "summary": {\n    "total_transactions": 2,\n') and "\\u003ca\\u003e \\u0026 b" in text
    assert list(told) == ["summary", "tables", "transactions", "minutes", "alerts", "warnings"] and told["warnings"] == 0
    assert told["summary"] == {"total_transactions": 2, "total_rows": 1503, "total_events": 7, "start_time": "2026-03-09T10:00:00Z", "end_time": "2026-03-09T10:16:01Z", "duration": "16m1s"}
    first, second = told["transactions"]
    assert first == {
        "txn_key": "txn-1",
        "start_time": "2026-03-09T10:00:00Z",
        "end_time": "2026-03-09T10:00:02Z",
        "duration": "2.5s",
        "total_rows": 1500,
        "event_count": 1,
        "tables": {"shop.orders": 1500},
        "operations": {"INSERT": 1500},
        "query_summary": "INSERT INTO t VALUES ('<a> & b')",
        "query_truncated": False,
        "query_original_bytes": len(SQL),
    }
    assert "query_truncated" not in second and "query_summary" not in second
    assert json.loads(R.json_of(result, "full"))["transactions"][0]["query_sql"] == SQL
    assert not any(k.startswith("query") for k in json.loads(R.json_of(result, "off"))["transactions"][0])
    assert told["minutes"][0] == {"minute": "2026-03-09T10:00:00Z", "total_rows": 1500, "txn_count": 1, "table_rows": {"shop.orders": 1500}}
    alert = told["alerts"][0]
    assert alert["details"] == {"duration_ms": 2500, "event_count": 1, "rows": 1500, "rows_threshold": 1000, "tables": ["shop.orders"]} and "minute" not in alert


def test_empty_json(spark):
    text = R.render_json(analyze_rows(spark, []))
    assert '"tables": [],\n' in text and '"start_time": "",\n' in text and text.endswith('"warnings": 0\n}')


def test_durations():
    exact = {0: "0s", 3: "3µs", 1500: "1.5ms", 250_000: "250ms", 2_500_000: "2.5s", 60_000_000: "1m0s", 899_000_000: "14m59s", 3_600_000_000: "1h0m0s", -5_000_000: "-5s", 90_061_000_001: "25h1m1.000001s"}
    assert {k: V.exact_duration(k) for k in exact} == exact
    short = {0: "0s", 250_000: "250ms", 999_999: "999ms", 2_340_000: "2.3s", 59_940_000: "59.9s", 60_000_000: "1m0s", -5_000_000: "-5000ms"}
    assert {k: V.short_duration(k) for k in short} == short


def test_json_values():
    assert V.to_json({"a": [], "b": {}, "c": [1, 2.5, 10.0, True, None], "d": "é \x01\"\\"}) == '{\n  "a": [],\n  "b": {},\n  "c": [\n    1,\n    2.5,\n    10,\n    true,\n    null\n  ],\n  "d": "é\\u2028\\u0001\\"\\\\"\n}'


def test_options():
    assert SqlContext.parse("") is SqlContext.SUMMARY
    with pytest.raises(ValueError, match=r'invalid --sql-context "x" \(allowed: summary, off, full\)'):
        SqlContext.parse("x")
    assert [parse_duration(t).total_seconds() for t in ("30s", "1m30s", "500ms", "1.5h", "0")] == [30, 90, 0.5, 5400, 0]
    for bad in ("", "x", "3", "1m x"):
        with pytest.raises(ValueError):
            parse_duration(bad)
    with pytest.raises(ValueError, match="end time must be after start time"):
        parse_time_range("2026-03-09T10:00:01Z", "2026-03-09T10:00:00Z")
    a, b = parse_time_range("2026-03-09T10:00:00Z", "2026-03-09T11:00:00+01:00")
    assert a == b and AnalysisOptions(end=b).naive_end() == datetime(2026, 3, 9, 10)
    for bad in ("2026-03-09", "2026-03-09 10:00:00Z", "2026-13-09T10:00:00Z", "2026-03-09T10:00:00"):
        with pytest.raises(ValueError):
            parse_time(bad, "start")


def raw_rows():
    def r(k, kind, **more):
        return {n: None for n in RAW_EVENT.names} | {"pos": 10 * k, "ts": at(k), "event_type": kind} | more

    return [r(0, "QUERY_EVENT", query="BEGIN"), r(1, "WRITE_ROWS_EVENTv2", schema="shop", table="orders", row_count=4), r(2, "ROTATE_EVENT"), r(3, "XID_EVENT")]


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("raw")
    frame = spark.createDataFrame(raw_rows(), RAW_EVENT).coalesce(1)
    frame.write.parquet(str(base / "a.parquet"))
    frame.write.json(str(base / "b.jsonl"))
    frame.write.csv(str(base / "c.csv"), header=True)
    return [str(base / n) for n in ("a.parquet", "b.jsonl", "c.csv")]


def run(spark, *argv):
    out = io.StringIO()
    return cli.main(["analyze", *argv], lambda: spark, out), out.getvalue()


def test_command_line(spark, files):
    code, text = run(spark, *files, "--json")
    told = json.loads(text)
    assert code == 0 and text.endswith("}\n")
    assert told["summary"]["total_transactions"] == 3 and told["summary"]["total_rows"] == 12 and told["summary"]["total_events"] == 9
    assert [t["txn_key"] for t in told["transactions"]] == ["txn-1", "txn-2", "txn-3"]
    code, text = run(spark, files[0], "--start", "2026-03-09T10:00:01Z", "--end", "2026-03-09T10:00:02Z")
    assert code == 0 and "Total Events: 1\n" in text


def test_a_transaction_may_cross_files(spark, tmp_path):
    rows_ = raw_rows()
    for k, part in enumerate((rows_[:2], rows_[2:])):
        spark.createDataFrame(part, RAW_EVENT).coalesce(1).write.parquet(str(tmp_path / f"{k}.parquet"))
    _, text = run(spark, str(tmp_path / "0.parquet"), str(tmp_path / "1.parquet"))
    assert "Total Transactions: 1\n" in text and "4 rows in 3.0s (1 events)" in text


def test_command_line_errors(spark, files, capsys):
    for argv, want in (
        ((files[0], "--start", "x"), 'Error: invalid start time "x": RFC3339 expected\n'),
        ((files[0], "--start", "2026-03-09T10:00:01Z", "--end", "2026-03-09T10:00:00Z"), "Error: end time must be after start time\n"),
        (("/nowhere/x.parquet", "--sql-context", "x"), 'Error: invalid --sql-context "x" (allowed: summary, off, full)\n'),
        (("/nowhere/x.parquet",), "Error: file not found: /nowhere/x.parquet\n"),
        ((files[0], files[0], "--large-trx-duration", "x"), 'Error: invalid duration "x"\n'),
    ):
        assert run(spark, *argv) == (1, "")
        assert capsys.readouterr().err == want


def test_command_line_failures(spark, tmp_path, capsys):
    (tmp_path / "log.000001").write_bytes(b"not a log at all")
    assert run(spark, str(tmp_path / "log.000001")) == (1, "")
    assert capsys.readouterr().err.startswith("Error: parse error: not a binary log")
    begins = [r | {"pos": 10 * k} for k, r in enumerate(raw_rows()[:1] * 2)]
    spark.createDataFrame(begins, RAW_EVENT).coalesce(1).write.parquet(str(tmp_path / "two.parquet"))
    assert run(spark, str(tmp_path / "two.parquet")) == (1, "")
    assert capsys.readouterr().err == "Error: analysis consume error: BEGIN received while explicit transaction txn-1 is in-flight\n"
