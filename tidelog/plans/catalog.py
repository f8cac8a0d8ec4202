"""The engine's own queries by name, over the adapted tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.sql_text import query_context, query_summary
from tidelog.operators import alerts as A
from tidelog.operators import stats as S
from tidelog.operators import transactions as T
from tidelog.operators.normalize import affected_rows, normalize
from tidelog.operators.window import in_window
from tidelog.options import MAX_SQL_BYTES, AnalysisOptions, TxnKeys
from tidelog.plans import oracle
from tidelog.plans.analyze import analyze
from tidelog.schemas import RESULT_TABLES
from tidelog.sources.adapters import ORDER_SPAN, activity_events, order_events, raw_events, table
from tidelog.sources.readers import in_file_order

Query = Callable[[SparkSession, str], DataFrame]

START, END = datetime(2024, 1, 1, 6), datetime(2024, 1, 2, 12)
#: Widths of runs in seq: some ten thousand events each.
ACTIVITY_RUN, ORDER_RUN = 1 << 14, ORDER_SPAN << 12
LIMIT = 10
SPIKES = AnalysisOptions(detect_spikes=True, large_txn_rows=100, large_txn_duration=timedelta(minutes=30))
TABLE_SPIKES = AnalysisOptions(detect_spikes=True, spike_min_rows=20, spike_factor=2.0)


def _activity_txns(spark: SparkSession, d: str) -> DataFrame:
    return T.assign_transactions(activity_events(spark, d), ACTIVITY_RUN)


def _order_txns(spark: SparkSession, d: str) -> DataFrame:
    return T.assign_transactions(normalize(order_events(spark, d)), ORDER_RUN)


def _flat(txns: DataFrame) -> DataFrame:
    return txns.select("txn_key", "start_time", "end_time", "duration_ms", "total_rows", "event_count", "query_summary", "query_truncated", "query_original_bytes")


def window_filter(spark: SparkSession, d: str) -> DataFrame:
    return in_window(activity_events(spark, d), START, END).select("seq", "ts", "event_type", "schema", "table", "operation", "row_count")


def normalize_events(spark: SparkSession, d: str) -> DataFrame:
    return normalize(order_events(spark, d)).select("seq", "ts", "event_type", "schema", "table", "operation", "row_count")


def affected_row_counts(spark: SparkSession, d: str) -> DataFrame:
    raw = order_events(spark, d).filter("event_type like '%ROWS%'")
    return raw.select("seq", "event_type", "row_count", affected_rows(F.col("event_type"), F.col("row_count")).alias("affected"))


def normalize_raw_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Every name of an event type, control words, bounded SQL; the rest dropped."""
    return normalize(raw_events(spark, d)).select("seq", "event_type", "schema", "table", "operation", "row_count", "query_sql", "query_truncated", "query_original_bytes")


def normalized_kinds(spark: SparkSession, d: str) -> DataFrame:
    """How many raw events of each type are known, and as what; update images halved."""
    raw = raw_events(spark, d)
    known = normalize(raw, halve_update_images=True).select("seq", F.col("event_type").alias("kind"), "row_count")
    told = raw.select("seq", "event_type").join(known, "seq", "left").groupBy("event_type", F.coalesce("kind", F.lit("")).alias("kind"))
    return told.agg(F.count("*").alias("events"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows"))


def transactions_over_files(spark: SparkSession, d: str) -> DataFrame:
    """Two files in order, whose transactions cross from one to the other."""
    raw = raw_events(spark, d).filter("event_type not in ('QueryEvent', 'QUERY_EVENT')")
    files = in_file_order([raw.filter("seq % 2 = 0"), raw.filter("seq % 2 = 1")])
    return T.transactions(T.assign_transactions(normalize(files), ACTIVITY_RUN)).select("txn_key", "start_time", "end_time", "duration_ms", "total_rows", "event_count", "query_truncated", "query_original_bytes")


def boundary_error(spark: SparkSession, d: str) -> DataFrame:
    """The first explicit transaction into which another begins."""
    return T.boundary_error(T.transactions(T.assign_transactions(normalize(raw_events(spark, d)), ACTIVITY_RUN)))


def first_transactions(spark: SparkSession, d: str) -> DataFrame:
    """In order of start."""
    return _flat(T.in_order(T.transactions(_activity_txns(spark, d))).limit(LIMIT))


def _stored(name: str) -> Query:
    """A result table as the store has it, through the whole analysis."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        options = AnalysisOptions(start=START, end=END, detect_spikes=True, large_txn_rows=SPIKES.large_txn_rows, large_txn_duration=SPIKES.large_txn_duration)
        frame = analyze(activity_events(spark, d), options, ACTIVITY_RUN).relational()[name]
        return frame.drop("details_json")

    query.__name__ = f"store_{name}"
    return query


def table_stats_all(spark: SparkSession, d: str) -> DataFrame:
    return S.table_stats(activity_events(spark, d))


def table_stats_orders(spark: SparkSession, d: str) -> DataFrame:
    return S.table_stats(normalize(order_events(spark, d)))


def table_stats_reconstructed(spark: SparkSession, d: str) -> DataFrame:
    events = activity_events(spark, d)
    return S.table_stats(S.with_reconstructed_keys(events, T.assign_transactions(events, ACTIVITY_RUN)))


def top_tables(spark: SparkSession, d: str) -> DataFrame:
    return S.top_tables(table_stats_all(spark, d), 5)


def top_tables_windowed(spark: SparkSession, d: str) -> DataFrame:
    return S.top_tables(S.table_stats(in_window(activity_events(spark, d), START, END)), 5)


def minute_buckets(spark: SparkSession, d: str) -> DataFrame:
    return S.minute_buckets(activity_events(spark, d))


def minute_table_rows(spark: SparkSession, d: str) -> DataFrame:
    return S.minute_table_rows(activity_events(spark, d))


def minute_activity(spark: SparkSession, d: str) -> DataFrame:
    """With the map of rows by table written out."""
    events = activity_events(spark, d)
    joined = S.with_table_map(S.minute_buckets(events), S.minute_table_rows(events))
    pairs = F.transform(F.map_entries("table_rows"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return joined.select("minute", "total_rows", "txn_count", F.array_join(pairs, ",").alias("table_rows"))


def transactions_implicit(spark: SparkSession, d: str) -> DataFrame:
    return _flat(T.transactions(_activity_txns(spark, d)))


def transactions_explicit(spark: SparkSession, d: str) -> DataFrame:
    return _flat(T.transactions(_order_txns(spark, d)))


def transactions_windowed(spark: SparkSession, d: str) -> DataFrame:
    """The window comes first and cuts transactions."""
    return _flat(T.transactions(T.assign_transactions(in_window(activity_events(spark, d), START, END), ACTIVITY_RUN)))


def top_transactions(spark: SparkSession, d: str) -> DataFrame:
    return _flat(T.top_transactions(T.transactions(_order_txns(spark, d)), LIMIT))


def top_transaction_sql(spark: SparkSession, d: str) -> DataFrame:
    """SQL is looked up for the top transactions only."""
    txns = T.transactions(_activity_txns(spark, d))
    top = T.top_transactions(txns.select("txn_key", "total_rows"), LIMIT)
    contexts = T.sql_contexts(txns).join(F.broadcast(top.select("txn_key")), "txn_key", "left_semi")
    return top.join(contexts, "txn_key", "left").select("txn_key", "total_rows", "query_sql", "query_truncated", "query_original_bytes")


def transaction_tables(spark: SparkSession, d: str) -> DataFrame:
    return T.transaction_tables(_activity_txns(spark, d))


def transaction_operations(spark: SparkSession, d: str) -> DataFrame:
    return T.transaction_operations(_order_txns(spark, d))


def transaction_sql_contexts(spark: SparkSession, d: str) -> DataFrame:
    return T.sql_contexts(T.transactions(_activity_txns(spark, d)))


def query_summaries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", query_summary(F.coalesce("text", F.lit(""))).alias("query_summary"))


def query_contexts(spark: SparkSession, d: str) -> DataFrame:
    told = table(spark, d, "documents").select("doc_id", query_context(F.coalesce("text", F.lit(""))).alias("c"))
    return told.filter("c is not null").select("doc_id", F.col("c.sql").alias("query_sql"), F.col("c.truncated").alias("query_truncated"), F.col("c.original_bytes").alias("query_original_bytes"))


def workload_summary(spark: SparkSession, d: str) -> DataFrame:
    events = activity_events(spark, d)
    return S.workload_summary(events, T.transactions(T.assign_transactions(events, ACTIVITY_RUN)))


def _large(spark: SparkSession, d: str, options: AnalysisOptions) -> DataFrame:
    assigned = _activity_txns(spark, d)
    return A.large_transaction_alerts(T.transactions(assigned), T.transaction_tables(assigned), options)


def large_txn_alerts(spark: SparkSession, d: str) -> DataFrame:
    told = _large(spark, d, SPIKES)
    return told.select("txn_key", "severity", "message", "rows", "duration_ms", "event_count", "rows_threshold", "duration_threshold_ms", F.array_join("tables", ",").alias("tables"))


def spike_alerts_overall(spark: SparkSession, d: str) -> DataFrame:
    return A.spike_alerts(S.minute_buckets(activity_events(spark, d)), AnalysisOptions(detect_spikes=True)).select("minute", "message", "rows", "baseline", "factor")


def spike_alerts_table(spark: SparkSession, d: str) -> DataFrame:
    events = activity_events(spark, d)
    return A.table_spike_alerts(S.minute_buckets(events), S.minute_table_rows(events), TABLE_SPIKES).select("minute", "message", "table", "rows", "baseline", "factor")


def alerts_all(spark: SparkSession, d: str) -> DataFrame:
    events = activity_events(spark, d)
    buckets = S.minute_buckets(events)
    every = _large(spark, d, SPIKES).unionByName(A.spike_alerts(buckets, SPIKES)).unionByName(A.table_spike_alerts(buckets, S.minute_table_rows(events), TABLE_SPIKES))
    return A.in_order(every).select("type", "severity", "txn_key", "minute", "message", "table", "rows")


def analysis_top_transactions(spark: SparkSession, d: str) -> DataFrame:
    """Through the whole analysis, boundary check and all."""
    result = analyze(activity_events(spark, d), AnalysisOptions(start=START, end=END, top_transactions=LIMIT, txn_keys=TxnKeys.INPUT), ACTIVITY_RUN)
    return result.transactions.select("txn_key", "total_rows", "event_count", F.array_join(F.map_keys("tables"), ",").alias("tables"), F.array_join(F.map_keys("operations"), ",").alias("operations"))


_ALL: tuple[Query, ...] = (
    window_filter,
    normalize_events,
    affected_row_counts,
    table_stats_all,
    table_stats_orders,
    table_stats_reconstructed,
    top_tables,
    top_tables_windowed,
    minute_buckets,
    minute_table_rows,
    minute_activity,
    transactions_implicit,
    transactions_explicit,
    transactions_windowed,
    top_transactions,
    top_transaction_sql,
    transaction_tables,
    transaction_operations,
    transaction_sql_contexts,
    query_summaries,
    query_contexts,
    workload_summary,
    large_txn_alerts,
    spike_alerts_overall,
    spike_alerts_table,
    alerts_all,
    analysis_top_transactions,
    normalize_raw_kinds,
    normalized_kinds,
    transactions_over_files,
    boundary_error,
    first_transactions,
    *map(_stored, RESULT_TABLES),
)

QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}
ORACLE_SQL: dict[str, str] = oracle.statements(START, END, LIMIT, MAX_SQL_BYTES, SPIKES, TABLE_SPIKES, ORDER_SPAN)
