"""Command line: tidelog analyze FILES..."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from tidelog.operators.transactions import TransactionBoundaryError
from tidelog.options import AnalysisOptions, SqlContext, parse_duration, parse_time_range
from tidelog.plans.analyze import analyze_raw
from tidelog.reports.render import write_json, write_text
from tidelog.sources.readers import FileSource, check_files


def session() -> SparkSession:
    spark = SparkSession.builder.appName("tidelog").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidelog", description="Analyse logs of row changes.")
    one = top.add_subparsers(dest="command", required=True).add_parser("analyze", help="analyse files of raw change events")
    one.add_argument("files", nargs="+")
    one.add_argument("--start", default="", help="start time, included (RFC 3339)")
    one.add_argument("--end", default="", help="end time, included (RFC 3339)")
    one.add_argument("--json", action="store_true", help="JSON output")
    one.add_argument("--sql-context", default="summary", help="summary, off or full")
    one.add_argument("--top-tables", type=int, default=10)
    one.add_argument("--top-transactions", type=int, default=10)
    one.add_argument("--detect-spikes", action="store_true")
    one.add_argument("--large-trx-rows", type=int, default=1000)
    one.add_argument("--large-trx-duration", default="30s")
    return top


def _gist(why: Exception) -> str:
    """The innermost message of an error that came through Spark."""
    told = [line.strip() for line in str(why).splitlines() if "Malformed" in line]
    return told[-1].partition(": ")[2] if told else str(why).splitlines()[0]


def main(argv: Sequence[str] | None = None, spark: Callable[[], SparkSession] = session, out=None) -> int:
    """Time range, SQL mode and files are checked, in this order, before anything runs."""
    asked = parser().parse_args(argv)
    try:
        start, end = parse_time_range(asked.start, asked.end)
        mode = SqlContext.parse(asked.sql_context)
        check_files(asked.files)
        options = AnalysisOptions(
            start=start,
            end=end,
            top_tables=asked.top_tables,
            top_transactions=asked.top_transactions,
            detect_spikes=asked.detect_spikes,
            large_txn_rows=asked.large_trx_rows,
            large_txn_duration=parse_duration(asked.large_trx_duration),
        )
        try:
            result = analyze_raw(FileSource(asked.files).load(spark()), options, hold=True)
            try:
                (write_json if asked.json else write_text)(result, out, mode)
            finally:
                result.release()
        except TransactionBoundaryError as why:
            raise ValueError(f"analysis consume error: {why}") from why
        except (PySparkException, Py4JError) as why:  # files are read only now
            raise ValueError(f"parse error: {_gist(why)}") from why
    except (ValueError, FileNotFoundError) as why:
        print(f"Error: {why}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
