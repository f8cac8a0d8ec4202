"""Alerts: oversized transactions, and write spikes against a rolling median."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.numbers import median_of_sorted
from tidelog.operators.stats import numbered_minutes
from tidelog.options import AnalysisOptions

# Fixed values of alert rows.
LARGE, SPIKE, SEVERITY = "large_transaction", "spike", "warning"
SPIKE_MESSAGE, TABLE_SPIKE_MESSAGE = "Write spike detected", "Table write spike detected"

#: Columns of an alert beside type, severity, message, txn_key and minute; null where they do not apply.
DETAILS = {
    "rows": "bigint",
    "duration_ms": "bigint",
    "event_count": "bigint",
    "rows_threshold": "bigint",
    "duration_threshold_ms": "bigint",
    "tables": "array<string>",
    "table": "string",
    "baseline": "bigint",
    "factor": "double",
}


def _alert(kind: str, message: Column, **columns: Column) -> list[Column]:
    base = {"type": F.lit(kind), "severity": F.lit(SEVERITY), "message": message, "txn_key": F.lit(""), "minute": F.lit(None).cast("timestamp_ntz")}
    base |= {name: F.lit(None).cast(t) for name, t in DETAILS.items()}
    base |= columns
    return [c.alias(n) for n, c in base.items()]


def large_transaction_alerts(txns: DataFrame, tables: DataFrame, options: AnalysisOptions) -> DataFrame:
    """One alert for each transaction over the row or the duration threshold, strictly; either may be off."""
    most_rows, most_ms = options.large_txn_rows, options.large_txn_duration // _millisecond()
    over_rows = F.lit(False) if most_rows <= 0 else F.col("total_rows") > most_rows
    over_time = F.lit(False) if most_ms <= 0 else F.col("duration_ms") > most_ms
    large = txns.filter(over_rows | over_time).select("txn_key", "total_rows", "duration_ms", "event_count")
    named = tables.join(large.select("txn_key"), "txn_key", "left_semi").groupBy("txn_key").agg(F.array_sort(F.collect_set("table_key")).alias("tables"))
    reasons = F.concat_ws(" and ", F.when(over_rows, "exceeds row threshold"), F.when(over_time, "exceeds duration threshold"))
    message = F.concat(F.lit("Transaction "), F.col("txn_key"), F.lit(" "), reasons)
    return large.join(named, "txn_key", "left").select(
        *_alert(
            LARGE,
            message,
            txn_key=F.col("txn_key"),
            rows=F.col("total_rows"),
            duration_ms=F.col("duration_ms"),
            event_count=F.col("event_count"),
            rows_threshold=F.when(over_rows, F.lit(most_rows).cast("bigint")),
            duration_threshold_ms=F.when(over_time, F.lit(most_ms).cast("bigint")),
            tables=F.col("tables"),
        )
    )


def _millisecond():
    from datetime import timedelta

    return timedelta(milliseconds=1)


def _is_spike(rows: Column, options: AnalysisOptions) -> Column:
    return (F.col("place") >= options.spike_window) & (rows >= options.spike_min_rows) & (F.col("baseline") > 0) & (rows / F.col("baseline") >= options.spike_factor)


def spike_alerts(buckets: DataFrame, options: AnalysisOptions) -> DataFrame:
    """Minutes whose rows are a multiple of the median of the minutes with rows before them."""
    n = options.spike_window
    before = Window.orderBy("place").rowsBetween(-n, -1) if n > 0 else None  # a row a minute
    past = F.sort_array(F.collect_list("total_rows").over(before)) if n > 0 else F.array().cast("array<bigint>")
    told = numbered_minutes(buckets).withColumn("past", past).filter(F.size("past") == n).withColumn("baseline", median_of_sorted(F.col("past"), n))
    rows = F.col("total_rows")
    return told.filter(_is_spike(rows, options)).select(*_alert(SPIKE, F.lit(SPIKE_MESSAGE), minute=F.col("minute"), rows=rows, baseline=F.col("baseline"), factor=rows / F.col("baseline")))


def table_spike_alerts(buckets: DataFrame, table_rows: DataFrame, options: AnalysisOptions) -> DataFrame:
    """The same by table; a minute before in which the table has no rows counts as 0, so none need be made up."""
    n = options.spike_window
    placed = table_rows.join(numbered_minutes(buckets).select("minute", "place"), "minute")
    before = Window.partitionBy("table_key").orderBy("place").rangeBetween(-n, -1)
    seen = F.collect_list("rows").over(before) if n > 0 else F.array().cast("array<bigint>")
    told = placed.withColumn("seen", seen)
    past = F.sort_array(F.concat(F.array_repeat(F.lit(0).cast("bigint"), F.lit(n) - F.size("seen")), "seen"))
    told = told.filter(F.col("rows") >= options.spike_min_rows).withColumn("baseline", median_of_sorted(past, n))
    rows = F.col("rows")
    return told.filter(_is_spike(rows, options)).select(*_alert(SPIKE, F.lit(TABLE_SPIKE_MESSAGE), minute=F.col("minute"), rows=rows, baseline=F.col("baseline"), factor=rows / F.col("baseline"), table=F.col("table_key")))


def in_order(alerts: DataFrame) -> DataFrame:
    """Large transactions first, then by minute, key, type, message and table."""
    rank = F.when(F.col("type") == LARGE, 0).otherwise(1)
    return alerts.orderBy(rank, F.col("minute").asc_nulls_first(), "txn_key", "type", "message", F.col("table").asc_nulls_first())


def details_json() -> Column:
    """The details that apply, as one JSON object."""
    named = F.struct("rows", "duration_ms", "event_count", "rows_threshold", "duration_threshold_ms", "tables", "table", "baseline", "factor", F.date_format("minute", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("minute"))
    return F.to_json(named)
