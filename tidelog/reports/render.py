"""Text and JSON reports of an analysis.

The summary is a row; tables and transactions are as many as the options ask
for.  Minutes and alerts are as many as there are and come to the driver a
partition at a time; written as text they pass through line by line.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from typing import Any, TextIO

from pyspark.sql import Row

from tidelog.operators.alerts import DETAILS
from tidelog.options import SqlContext
from tidelog.plans.analyze import AnalysisResult
from tidelog.reports.values import clock, exact_duration, rfc3339, short_duration, to_json

# Section titles, and what stands in an empty section.
TITLES = ("Workload Summary", "Top Tables", "Top Transactions", "Minute Activity", "Alerts")
EMPTY = (None, "(no table activity)", "(no transactions)", "(no minute activity)", "(no alerts)")


def collected(result: AnalysisResult, many: Callable[[Iterator[Row]], Iterable[Row]] = list) -> dict[str, Any]:
    """The report's rows: the summary, top tables, top transactions, minutes and alerts; the last two as ``many`` takes them."""
    return {
        "summary": result.summary.first(),
        "tables": result.tables.collect(),
        "transactions": result.transactions.collect(),
        "minutes": many(result.minutes.toLocalIterator()),
        "alerts": many(result.alerts.toLocalIterator()),
        "warnings": result.warnings,
    }


def _text_query(txn: Row, mode: SqlContext) -> str:
    return {SqlContext.OFF: "", SqlContext.FULL: txn["query_sql"], SqlContext.SUMMARY: txn["query_summary"]}[mode]


def _sections(rows: dict[str, Any], mode: SqlContext) -> Iterator[Iterable[str]]:
    s = rows["summary"]
    yield [
        f"Total Transactions: {s['total_transactions']}",
        f"Total Rows: {s['total_rows']}",
        f"Total Events: {s['total_events']}",
        f"Time Range: {clock(s['start_time'])} - {clock(s['end_time'])}",
        f"Duration: {short_duration(s['duration_us'])}",
    ]
    yield [f"{t['schema']}.{t['table']}: {t['total_rows']} rows ({t['insert_rows']} insert, {t['update_rows']} update, {t['delete_rows']} delete, {t['txn_count']} txn)" for t in rows["tables"]]
    lines = []
    for t in sorted(rows["transactions"], key=lambda t: (-t["total_rows"], t["txn_key"])):
        lines.append(f"{t['txn_key']}: {t['total_rows']} rows in {short_duration(1000 * t['duration_ms'])} ({t['event_count']} events)")
        if query := _text_query(t, mode):
            lines.append(f"  Query: {query}")
    yield lines
    yield (f"{m['minute']:%Y-%m-%d %H:%M}: {m['total_rows']} rows, {m['txn_count']} txn" for m in rows["minutes"])
    yield (f"[{a['severity'].upper()}] {a['type']}: {a['message']}" for a in rows["alerts"])


def lines_of(rows: dict[str, Any], mode: SqlContext | str = SqlContext.SUMMARY) -> Iterator[str]:
    """The text report, line by line."""
    for title, empty, lines in zip(TITLES, EMPTY, _sections(rows, SqlContext.or_default(mode)), strict=True):
        yield f"=== {title} ==="
        count = 0
        for count, line in enumerate(lines, 1):
            yield f"  {line}"
        if not count:
            yield f"  {empty}"
        yield ""


def text_of(rows: dict[str, Any], mode: SqlContext | str = SqlContext.SUMMARY) -> str:
    return "\n".join(lines_of(rows, mode)) + "\n"


def _sorted(counts: dict[str, int] | None) -> dict[str, int]:
    return dict(sorted((counts or {}).items()))


def _without_empty(d: dict[str, Any], *names: str) -> dict[str, Any]:
    return {k: v for k, v in d.items() if k not in names or v}


def _transaction(t: Row, mode: SqlContext) -> dict[str, Any]:
    us = 1000 * t["duration_ms"]
    out = {
        "txn_key": t["txn_key"],
        "start_time": rfc3339(t["start_time"]),
        "end_time": rfc3339(t["end_time"]),
        "duration": exact_duration(us),
        "total_rows": t["total_rows"],
        "event_count": t["event_count"],
        "tables": _sorted(t["tables"]),
        "operations": _sorted(t["operations"]),
    }
    if mode != SqlContext.OFF:
        out["query_summary"] = t["query_summary"]
        if t["query_original_bytes"] > 0:
            if mode == SqlContext.FULL:
                out["query_sql"] = t["query_sql"]
            out |= {"query_truncated": t["query_truncated"], "query_original_bytes": t["query_original_bytes"]}
    return _without_empty(out, "tables", "operations", "query_summary", "query_sql")


def _alert(a: Row) -> dict[str, Any]:
    details = {k: a[k] for k in DETAILS if a[k] is not None}
    if a["minute"] is not None:
        details["minute"] = a["minute"]
    out = {"type": a["type"], "severity": a["severity"], "message": a["message"], "txn_key": a["txn_key"], "minute": rfc3339(a["minute"]), "details": dict(sorted(details.items()))}
    return _without_empty(out, "txn_key", "minute", "details")


def json_of(rows: dict[str, Any], mode: SqlContext | str = SqlContext.SUMMARY) -> str:
    mode, s = SqlContext.or_default(mode), rows["summary"]
    counts = ("schema", "table", "total_rows", "insert_rows", "update_rows", "delete_rows", "txn_count")
    return to_json(
        {
            "summary": {
                "total_transactions": s["total_transactions"],
                "total_rows": s["total_rows"],
                "total_events": s["total_events"],
                "start_time": rfc3339(s["start_time"]),
                "end_time": rfc3339(s["end_time"]),
                "duration": exact_duration(s["duration_us"]),
            },
            "tables": [{c: t[c] for c in counts} for t in rows["tables"]],
            "transactions": [_transaction(t, mode) for t in rows["transactions"]],
            "minutes": [_without_empty({"minute": rfc3339(m["minute"]), "total_rows": m["total_rows"], "txn_count": m["txn_count"], "table_rows": _sorted(m["table_rows"])}, "table_rows") for m in rows["minutes"]],
            "alerts": [_alert(a) for a in rows["alerts"]],
            "warnings": rows["warnings"],
        }
    )


def render_text(result: AnalysisResult, mode: SqlContext | str = SqlContext.SUMMARY) -> str:
    return text_of(collected(result), mode)


def render_json(result: AnalysisResult, mode: SqlContext | str = SqlContext.SUMMARY) -> str:
    return json_of(collected(result), mode)


def write_text(result: AnalysisResult, out: TextIO | None = None, mode: SqlContext | str = SqlContext.SUMMARY) -> None:
    out = out or sys.stdout
    for line in lines_of(collected(result, iter), mode):
        out.write(line + "\n")


def write_json(result: AnalysisResult, out: TextIO | None = None, mode: SqlContext | str = SqlContext.SUMMARY) -> None:
    """As the string, with a line end after it."""
    (out or sys.stdout).write(render_json(result, mode) + "\n")
