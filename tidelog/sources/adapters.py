"""Events out of tables that hold other things, so that every analysis has data to run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.operators.normalize import complete
from tidelog.schemas import RAW_EVENT

#: Places in the total order for one order's events.
ORDER_SPAN = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def activity_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User events as normalised events: errors close, views tell SQL, the rest change rows."""
    kind = F.col("event_type")
    operation = F.when(kind == "signup", "INSERT").when(kind == "purchase", "UPDATE").when(kind == "click", "DELETE").otherwise("")
    event = F.when(kind == "error", "XID").when(kind == "view", "ROWS_QUERY").otherwise("ROWS")
    is_rows, is_sql = F.col("event_type") == "ROWS", F.col("event_type") == "ROWS_QUERY"
    told = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        "ts",
        event.alias("event_type"),
        F.concat(F.lit("u"), "user_id").alias("txn_key"),
        operation.alias("operation"),
        F.floor("value").cast("bigint").alias("rows"),
        F.concat(F.lit("t"), F.col("user_id") % 8).alias("name"),
        F.coalesce("props", F.lit("")).alias("props"),
    )
    return complete(
        told.select(
            "seq",
            "ts",
            "event_type",
            "txn_key",
            F.when(is_rows, "app").alias("schema"),
            F.when(is_rows, F.col("name")).alias("table"),
            F.when(is_rows, F.col("operation")).alias("operation"),
            F.when(is_rows, F.col("rows")).alias("row_count"),
            F.when(is_sql, F.col("props")).alias("query_sql"),
            F.when(is_sql, F.octet_length("props")).cast("bigint").alias("query_original_bytes"),
        )
    )


# What the raw log's events are, by event_id modulo their number, and the text of its queries by user.
RAW_KINDS = ("WriteRowsEventV2", "UPDATE_ROWS_EVENTv1", "DeleteRowsEventV0", "WRITE_ROWS_EVENT", "UpdateRowsEvent", "DELETE_ROWS_EVENTv2", "TableMapEvent", "TABLE_MAP_EVENT", "XIDEvent", "QueryEvent", "QUERY_EVENT", "RowsQueryEvent", "ROWS_QUERY_EVENT", "FormatDescriptionEvent", "writeRowsEvent", "ROTATE_EVENT")
RAW_QUERIES = (" begin ", "COMMIT\n", "ROLLBACK", "CREATE TABLE t (x int)", "\u00a0Commit\u00a0", "BEGIN", "", "savepoint a")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User events as a raw log with every name that event types go by, queries, SQL of any length, and events that no analysis knows."""
    kinds, queries = (F.array(*[F.lit(v) for v in values]) for values in (RAW_KINDS, RAW_QUERIES))
    kind = F.element_at(kinds, (F.col("event_id") % len(RAW_KINDS) + 1).cast("int"))
    sql = F.concat(F.repeat(F.concat(F.coalesce("props", F.lit("")), F.lit(" é")), (F.col("event_id") % 97 * 8).cast("int")), F.lit(""))
    told = table(spark, sf_dir, "events").select(
        F.lit(0).alias("file_idx"),
        F.col("event_id").alias("seq"),
        "ts",
        kind.alias("event_type"),
        F.lit("app").alias("schema"),
        F.concat(F.lit("t"), F.col("user_id") % 8).alias("table"),
        F.when(kind.isin("QueryEvent", "QUERY_EVENT"), F.element_at(queries, (F.col("user_id") % len(RAW_QUERIES) + 1).cast("int"))).alias("query"),
        F.when(kind.isin("RowsQueryEvent", "ROWS_QUERY_EVENT"), F.when(F.col("user_id") % 5 > 0, sql)).alias("query_sql"),
        F.floor("value").cast("bigint").alias("row_count"),
        F.col("event_id").alias("pos"),
    )
    return told.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in RAW_EVENT.fields])


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as raw events: BEGIN, a rows event for each item, and the closing event."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("ordered"))
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("key"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", F.col("l_shipdate").alias("shipped")
    )
    kind = F.when(F.col("l_returnflag") == "A", "WRITE_ROWS_EVENTv2").when(F.col("l_returnflag") == "N", "UPDATE_ROWS_EVENTv2").otherwise("DELETE_ROWS_EVENTv2")
    place = F.row_number().over(Window.partitionBy("key").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "shipped"))
    rows = items.join(orders.select("key"), "key", "left_semi").select(
        "key", place.cast("bigint").alias("place"), F.col("shipped").alias("ts"), kind.alias("event_type"), F.lit("shop").alias("schema"), F.concat(F.lit("p"), F.col("l_partkey") % 16).alias("table"), F.col("l_quantity").cast("bigint").alias("row_count")
    )
    begins = orders.select("key", F.lit(0).cast("bigint").alias("place"), F.col("ordered").alias("ts"), F.lit("QUERY_EVENT").alias("event_type"), F.lit("BEGIN").alias("query"))
    last = items.groupBy("key").agg(F.max("shipped").alias("shipped"))
    ends = orders.join(last, "key", "left").select("key", F.lit(ORDER_SPAN - 1).cast("bigint").alias("place"), F.coalesce("shipped", "ordered").alias("ts"), F.lit("XID_EVENT").alias("event_type"))
    every = rows.unionByName(begins, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True)
    every = every.withColumns({"seq": F.col("key") * ORDER_SPAN + F.col("place"), "file_idx": F.lit(0), "pos": F.col("place")})
    return every.select(*[(F.col(f"`{f.name}`") if f.name in every.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW_EVENT.fields])
