"""The analyses over a stream of normalised events, by Structured Streaming.

Minutes close when the watermark passes them; later events of a closed minute
are dropped, as a second row for it would be wrong.  Transactions are kept per
stream in keyed state and come out when they close.  A stream's events must
arrive in order, batch after batch; within a batch they are put in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidelog.operators import alerts as A
from tidelog.operators.stats import MUTATIONS
from tidelog.options import AnalysisOptions


def _txns() -> F.Column:
    """Distinct counts are not for streams; a set is."""
    return F.size(F.collect_set(F.when(F.col("txn_key") != "", F.col("txn_key")))).cast("bigint").alias("txn_count")


def live_table_stats(events: DataFrame, count_txns: bool = True) -> DataFrame:
    """Rows by table so far, for the output modes update and complete.

    The distinct transactions so far are kept in the state, which so grows with
    them; without ``count_txns`` the state is a row a table.
    """
    rows = F.col("row_count")
    by_operation = [F.sum(F.when(F.col("operation") == op, rows).otherwise(0)).alias(f"{op.lower()}_rows") for op in MUTATIONS]
    eligible = events.filter(F.col("operation").isin(*MUTATIONS) & (F.col("schema") != "") & (F.col("table") != ""))
    return eligible.groupBy("schema", "table").agg(F.sum(rows).alias("total_rows"), *by_operation, *([_txns()] if count_txns else []))


def _minutes(events: DataFrame, delay: str) -> DataFrame:
    counted = events.filter((F.col("schema") != "") & (F.col("table") != "") & (F.col("row_count") != 0))
    return counted.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def live_minute_buckets(events: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Closed minutes, for the output mode append."""
    told = _minutes(events, delay).groupBy(F.window("ts", "1 minute")).agg(F.sum("row_count").alias("total_rows"), _txns())
    return told.select(F.col("window.start").cast("timestamp_ntz").alias("minute"), "total_rows", "txn_count")


def live_minute_table_rows(events: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Rows of closed minutes by table, for the output mode append."""
    key = F.concat_ws(".", "schema", "table").alias("table_key")
    told = _minutes(events, delay).groupBy(F.window("ts", "1 minute"), key).agg(F.sum("row_count").alias("rows"))
    return told.select(F.col("window.start").cast("timestamp_ntz").alias("minute"), "table_key", "rows")


TXN = T.StructType().add("stream_id", "string").add("txn_key", "string").add("start_time", "timestamp").add("end_time", "timestamp").add("total_rows", "long").add("event_count", "long").add("query_sql", "string").add("error", "string")
#: Counter, whether a transaction is open and explicit, its times, counts and SQL.
STATE = T.StructType().add("n", "long").add("open", "boolean").add("explicit", "boolean").add("start", "timestamp").add("end", "timestamp").add("rows", "long").add("events", "long").add("sql", "string")


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, is_open, explicit, start, end, rows, events, sql = state.get if state.exists else (0, False, False, None, None, 0, 0, "")
    out = []

    def close(at) -> None:
        nonlocal is_open
        out.append((key[0], f"txn-{n}", start, at, rows, events, sql, ""))
        is_open = False

    def begin(at, named: bool) -> None:
        nonlocal n, is_open, explicit, start, end, rows, events, sql
        n, is_open, explicit, start, end, rows, events, sql = n + 1, True, named, at, at, 0, 0, ""

    frame = pd.concat(list(batches)).sort_values("seq")
    for kind, ts, count, text in zip(frame["event_type"], frame["ts"], frame["row_count"], frame["query_sql"], strict=True):
        if kind == "BEGIN":
            if is_open and explicit:
                out.append((key[0], f"txn-{n}", start, None, rows, events, sql, f"BEGIN received while explicit transaction txn-{n} is in-flight"))
                continue
            if is_open:
                close(end)
            begin(ts, True)
        elif kind in ("COMMIT", "XID"):
            if is_open:
                close(ts if explicit else end)
        elif kind in ("ROWS", "ROWS_QUERY"):
            if not is_open:
                begin(ts, False)
            if kind == "ROWS_QUERY":
                sql = text or ""
            else:
                rows, events, end = rows + int(count or 0), events + 1, ts
    state.update((n, is_open, explicit, start, end, rows, events, sql))
    yield pd.DataFrame(out, columns=TXN.names)


def live_transactions(events: DataFrame) -> DataFrame:
    """Closed transactions of each stream_id; a row with an error where a BEGIN came too early."""
    slim = events.withColumn("ts", F.col("ts").cast("timestamp")).select("stream_id", "seq", "ts", "event_type", "row_count", "query_sql")
    return slim.groupBy("stream_id").applyInPandasWithState(_advance, TXN, STATE, "append", GroupStateTimeout.NoTimeout)


Watch = Callable[[DataFrame, int], None]


def _watch(history: str, options: AnalysisOptions, sink: Watch, alerts: Callable[[DataFrame], DataFrame]) -> Watch:
    """For foreachBatch on closed minutes: gives the alerts of the batch's minutes to ``sink``.

    history: a folder for the last minutes, as many as the window has, after
    each batch.  A batch reads what the batch before it left, so its cost does
    not grow with the stream, and run again it reads and writes the same.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark, folder = batch.sparkSession, history.rstrip("/")
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        left = sorted(int(f.getPath().getName().partition("=")[2]) for f in (fs.listStatus(at) if fs.exists(at) else []) if f.getPath().getName().startswith("after="))
        earlier = [n for n in left if n < number]
        batch = batch.persist()
        try:
            if batch.isEmpty():
                return
            near = batch
            if earlier:
                near = spark.read.schema(batch.schema).parquet(f"{folder}/after={earlier[-1]}").unionByName(batch)
            last = [r["minute"] for r in near.select("minute").distinct().orderBy(F.desc("minute")).limit(max(1, options.spike_window)).collect()]
            near.filter(F.col("minute") >= F.lit(last[-1]).cast("timestamp_ntz")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/after={number}")
            first = batch.agg(F.min("minute")).first()[0]
            sink(alerts(near).filter(F.col("minute") >= F.lit(first).cast("timestamp_ntz")), number)
            for n in earlier[:-1]:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/after={n}"), True)
        finally:
            batch.unpersist()

    return handle


def spike_watch(history: str, options: AnalysisOptions, sink: Watch) -> Watch:
    """On live_minute_buckets: the overall spikes."""
    return _watch(history, options, sink, lambda minutes: A.spike_alerts(minutes, options))


def table_spike_watch(history: str, options: AnalysisOptions, sink: Watch) -> Watch:
    """On live_minute_table_rows: the spikes of tables and, as their rows make up the minute's, the overall ones."""

    def both(rows: DataFrame) -> DataFrame:
        minutes = rows.groupBy("minute").agg(F.sum("rows").alias("total_rows"))
        return A.spike_alerts(minutes, options).unionByName(A.table_spike_alerts(minutes, rows, options))

    return _watch(history, options, sink, both)
