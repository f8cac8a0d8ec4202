"""Statistics by table, by minute, and of the whole workload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.numbers import micros, minute_of, sorted_map

MUTATIONS = ("INSERT", "UPDATE", "DELETE")


def is_row_mutation(operation: Column) -> Column:
    return operation.isin(*MUTATIONS)


def _named() -> Column:
    return (F.col("schema") != "") & (F.col("table") != "")


def _distinct_txns() -> Column:
    return F.count_distinct(F.when(F.col("txn_key") != "", F.col("txn_key"))).alias("txn_count")


def with_reconstructed_keys(events: DataFrame, assigned: DataFrame) -> DataFrame:
    """Events whose txn_key is that of the transaction they were found to belong to, or empty."""
    from tidelog.operators.transactions import txn_key

    keys = assigned.select("seq", txn_key(F.col("txn_id")).alias("_key"))
    return events.join(keys, "seq", "left").withColumn("txn_key", F.coalesce("_key", F.lit(""))).drop("_key")


def table_stats(events: DataFrame) -> DataFrame:
    """Rows by table and operation, and distinct transactions.  A mutation of 0 rows counts its table in."""
    rows = F.col("row_count")
    by_operation = [F.sum(F.when(F.col("operation") == op, rows).otherwise(0)).alias(f"{op.lower()}_rows") for op in MUTATIONS]
    eligible = events.filter(is_row_mutation(F.col("operation")) & _named())
    return eligible.groupBy("schema", "table").agg(F.sum(rows).alias("total_rows"), *by_operation, _distinct_txns())


def top_tables(stats: DataFrame, limit: int) -> DataFrame:
    """By rows, most first, then by name; a limit of 0 or less is none."""
    ranked = stats.orderBy(F.desc("total_rows"), "schema", "table")
    return ranked.limit(limit) if limit > 0 else ranked


def _by_minute(events: DataFrame) -> DataFrame:
    return events.filter(_named() & (F.col("row_count") != 0)).withColumn("minute", minute_of(F.col("ts")))


def minute_buckets(events: DataFrame) -> DataFrame:
    """Rows and distinct transactions by calendar minute; minutes without rows have no row.  Late events join their minute."""
    return _by_minute(events).groupBy("minute").agg(F.sum("row_count").alias("total_rows"), _distinct_txns())


def minute_table_rows(events: DataFrame) -> DataFrame:
    """Rows by calendar minute and table."""
    key = F.concat_ws(".", "schema", "table").alias("table_key")
    return _by_minute(events).groupBy("minute", key).agg(F.sum("row_count").alias("rows"))


def with_table_map(buckets: DataFrame, table_rows: DataFrame) -> DataFrame:
    """Minutes in order, each with its map of rows by table."""
    maps = table_rows.groupBy("minute").agg(sorted_map(F.col("table_key"), F.col("rows")).alias("table_rows"))
    return buckets.join(maps, "minute", "left").orderBy("minute")


def event_summary(events: DataFrame) -> DataFrame:
    """One row: how many events, first and last time."""
    return events.agg(F.count("*").alias("total_events"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time"))


def workload_summary(events: DataFrame, txns: DataFrame) -> DataFrame:
    """One row over all events in the window and all transactions; zeros and nulls without any."""
    counted = txns.agg(F.count("*").alias("total_transactions"), F.sum("total_rows").alias("total_rows"))
    both = counted.unionByName(event_summary(events), allowMissingColumns=True)  # two rows
    told = both.agg(*[F.max(c).alias(c) for c in ("total_transactions", "total_rows", "total_events", "start_time", "end_time")])
    duration = F.coalesce(micros(F.col("end_time")) - micros(F.col("start_time")), F.lit(0)).alias("duration_us")
    return told.select("total_transactions", F.coalesce("total_rows", F.lit(0)).alias("total_rows"), "total_events", "start_time", "end_time", duration)


def numbered_minutes(buckets: DataFrame) -> DataFrame:
    """Minutes with their place among those that have rows; a row a minute, so one task orders them."""
    return buckets.withColumn("place", F.row_number().over(Window.orderBy("minute")) - 1)
