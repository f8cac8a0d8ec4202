"""Transactions out of ordered events, without sorting them in one place.

Events are told by kind: B for BEGIN, C for COMMIT and XID, R for ROWS and
ROWS_QUERY; numbers stand for them, which aggregates hold in place.  A transaction starts at each B, and at an R that follows a C or
nothing; a C that follows a C or nothing closes nothing.  So each event depends
on the one before it and on how many starts precede it, and both compose over
runs of events: a run tells its first and last kind and its starts.  Events
are cut into runs by seq, runs are summed up, the small table of runs is
scanned in order, and each run is numbered by itself.  A table of very many runs is
scanned in the same way: cut into stretches of runs, which are summed up, so
that one task orders only a row a stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.numbers import millis_between, sorted_map
from tidelog.functions.sql_text import query_summary

#: Width of a run in seq. Choose it so that a run has some hundred thousand events.
RUN = 1 << 20
#: Runs in a stretch.
STRETCH = 1 << 12

B, C, R = 0, 1, 2


class TransactionBoundaryError(ValueError):
    """A BEGIN came while an explicit transaction was open."""

    def __init__(self, number: int):
        super().__init__(f"BEGIN received while explicit transaction txn-{number} is in-flight")
        self.number = number


#: Event types that make up transactions.
RELEVANT = ("BEGIN", "COMMIT", "XID", "ROWS", "ROWS_QUERY")


def _kind() -> Column:
    """Of a relevant event."""
    t = F.col("event_type")
    return F.when(t == "BEGIN", B).when(t.isin("COMMIT", "XID"), C).otherwise(R)


def _starts(kind: Column, before: Column) -> Column:
    return (kind == B) | ((kind == R) & (F.coalesce(before, F.lit(C)) == C))


def _runs_in_order(runs: DataFrame) -> DataFrame:
    """The same as _placed_runs, by one task."""
    in_order = Window.orderBy("run")  # a row a run, not a row an event
    runs = runs.withColumn("last_before", F.lag("last_kind").over(in_order))
    runs = runs.withColumn("first_start", _starts(F.col("first_kind"), F.col("last_before")).cast("bigint"))
    earlier = F.sum(F.col("inner_starts") + F.col("first_start")).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    return runs.select("run", "last_before", (F.coalesce(earlier, F.lit(0)) + F.col("first_start")).alias("starts_to_first"))


def _placed_runs(runs: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """run, the last kind before it, and the starts up to and with its first event.  runs: run, first_kind, last_kind, inner_starts."""
    within = Window.partitionBy("stretch").orderBy("run")
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.withColumn("stretch", F.floor(F.col("run") / stretch)).withColumn("last_within", F.lag("last_kind").over(within))
    first = F.col("last_within").isNull()  # of its stretch, as every run has a last kind
    runs = runs.withColumn("known_start", F.when(~first, _starts(F.col("first_kind"), F.col("last_within"))).otherwise(False).cast("bigint"))
    runs = runs.withColumn("known_starts", F.sum(F.col("inner_starts") + F.col("known_start")).over(so_far))
    summed = runs.groupBy("stretch").agg(F.min_by("first_kind", "run").alias("head"), F.max_by("last_kind", "run").alias("tail"), F.max("known_starts").alias("starts"))
    in_order = Window.orderBy("stretch")  # a row a stretch, not a row a run
    summed = summed.withColumn("tail_before", F.lag("tail").over(in_order))
    summed = summed.withColumn("head_start", _starts(F.col("head"), F.col("tail_before")).cast("bigint"))
    earlier = F.sum(F.col("starts") + F.col("head_start")).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    summed = summed.select("stretch", "tail_before", (F.coalesce(earlier, F.lit(0)) + F.col("head_start")).alias("before"))
    told = runs.join(summed.hint("merge"), "stretch")
    return told.select("run", F.coalesce("last_within", "tail_before").alias("last_before"), (F.col("before") + F.col("known_starts") - F.col("inner_starts")).alias("starts_to_first"))


def assign_transactions(events: DataFrame, run: int = RUN, stretch: int = 0) -> DataFrame:
    """The events that belong to transactions, with kind and txn_id, from 1 in order of start.

    stretch: runs in a stretch; with 0 one task orders a row a run, which reads
    the events once less and is enough up to some millions of runs.
    """
    own = Window.partitionBy("run").orderBy("seq")
    marked = (
        # By type, not by kind: Catalyst would write kind's conditions out in the filter, over those of the type, too long to be compiled.
        events.filter(F.col("event_type").isin(*RELEVANT))
        .withColumn("kind", _kind())
        .withColumn("run", F.floor(F.col("seq") / run))
        .withColumns({"before": F.lag("kind").over(own), "place": F.row_number().over(own)})
        .withColumn("inner_start", (_starts(F.col("kind"), F.col("before")) & (F.col("place") > 1)).cast("bigint"))
    )
    runs = marked.groupBy("run").agg(
        F.min_by("kind", "seq").alias("first_kind"),
        F.max_by("kind", "seq").alias("last_kind"),
        F.sum("inner_start").alias("inner_starts"),
    )
    runs = _placed_runs(runs, stretch) if stretch else _runs_in_order(runs)
    counted = marked.withColumn("inner_so_far", F.sum("inner_start").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    # A merge join keeps the events where the window over their run has put them.
    joined = counted.join(runs.hint("merge"), "run")
    before = F.when(F.col("place") == 1, F.col("last_before")).otherwise(F.col("before"))
    orphan = (F.col("kind") == C) & (F.coalesce(before, F.lit(C)) == C)
    return joined.filter(~orphan).select(*[f"`{c}`" for c in events.columns], "kind", (F.col("starts_to_first") + F.col("inner_so_far")).alias("txn_id"))


def txn_key(txn_id: Column) -> Column:
    return F.concat(F.lit("txn-"), txn_id.cast("string"))


def transactions(assigned: DataFrame) -> DataFrame:
    """A row a transaction: key, times, counts, SQL context, whether explicit and closed.

    An explicit, closed transaction ends with its closing event; any other
    with its last ROWS event in order, or where it started.
    """
    is_rows, is_sql = F.col("event_type") == "ROWS", F.col("event_type") == "ROWS_QUERY"
    sql = F.struct("query_sql", "query_truncated", "query_original_bytes")
    told = assigned.groupBy("txn_id").agg(
        F.min_by("kind", "seq").alias("first_kind"),
        F.bool_or(F.col("kind") == C).alias("closed"),
        F.min_by("ts", "seq").alias("start_time"),
        F.max_by("ts", "seq").alias("last_time"),
        F.max_by(F.when(is_rows, F.col("ts")), F.when(is_rows, F.col("seq"))).alias("last_rows_time"),
        F.coalesce(F.sum(F.when(is_rows, F.col("row_count"))), F.lit(0)).alias("total_rows"),
        F.count_if(is_rows).alias("event_count"),
        F.max_by(F.when(is_sql, sql), F.when(is_sql, F.col("seq"))).alias("sql"),
    )
    explicit = F.col("first_kind") == B
    end = F.when(explicit & F.col("closed"), F.col("last_time")).otherwise(F.coalesce("last_rows_time", "start_time"))
    text = F.coalesce(F.col("sql.query_sql"), F.lit(""))
    return told.withColumn("end_time", end).select(
        "txn_id",
        txn_key(F.col("txn_id")).alias("txn_key"),
        "start_time",
        "end_time",
        millis_between(F.col("start_time"), F.col("end_time")).alias("duration_ms"),
        "total_rows",
        "event_count",
        query_summary(text).alias("query_summary"),
        text.alias("query_sql"),
        (F.coalesce(F.col("sql.query_truncated"), F.lit(False)) & (text != "")).alias("query_truncated"),
        F.when(text != "", F.col("sql.query_original_bytes")).otherwise(0).cast("bigint").alias("query_original_bytes"),
        explicit.alias("explicit"),
        "closed",
    )


def boundary_error(txns: DataFrame) -> DataFrame:
    """A row (number, message) if an explicit transaction other than the last was never closed, for the first such; else none."""
    open_ids = F.when(F.col("explicit") & ~F.col("closed"), F.col("txn_id"))
    found = txns.agg(F.max("txn_id").alias("last"), F.min(open_ids).alias("number")).filter("number < last")
    return found.select("number", F.concat(F.lit("BEGIN received while explicit transaction txn-"), F.col("number").cast("string"), F.lit(" is in-flight")).alias("message"))


def check_boundaries(txns: DataFrame) -> None:
    """Raises if there is a boundary error.  One small aggregate."""
    found = boundary_error(txns).first()
    if found is not None:
        raise TransactionBoundaryError(found["number"])


def transaction_tables(assigned: DataFrame) -> DataFrame:
    """Rows by transaction and table, of ROWS events that name both schema and table."""
    named = assigned.filter("event_type = 'ROWS' and schema <> '' and `table` <> ''")
    return named.groupBy("txn_id", F.concat_ws(".", "schema", "table").alias("table_key")).agg(F.sum("row_count").alias("rows")).select(txn_key(F.col("txn_id")).alias("txn_key"), "table_key", "rows")


def transaction_operations(assigned: DataFrame) -> DataFrame:
    """Rows by transaction and operation."""
    named = assigned.filter("event_type = 'ROWS' and operation <> ''")
    return named.groupBy("txn_id", "operation").agg(F.sum("row_count").alias("rows")).select(txn_key(F.col("txn_id")).alias("txn_key"), "operation", "rows")


def sql_contexts(txns: DataFrame) -> DataFrame:
    """The bounded SQL of transactions that have any."""
    return txns.filter("query_sql <> ''").select("txn_key", "query_sql", "query_truncated", "query_original_bytes")


def with_maps(txns: DataFrame, tables: DataFrame, operations: DataFrame) -> DataFrame:
    """Transactions with maps of rows by table and by operation."""
    by_table = tables.groupBy("txn_key").agg(sorted_map(F.col("table_key"), F.col("rows")).alias("tables"))
    by_operation = operations.groupBy("txn_key").agg(sorted_map(F.col("operation"), F.col("rows")).alias("operations"))
    none = F.expr("map_from_entries(cast(array() as array<struct<k:string,v:bigint>>))")
    return txns.join(by_table, "txn_key", "left").join(by_operation, "txn_key", "left").withColumns({"tables": F.coalesce("tables", none), "operations": F.coalesce("operations", none)})


def top_transactions(txns: DataFrame, limit: int) -> DataFrame:
    """By rows, most first, then by key as text; a limit of 0 or less is none."""
    ranked = txns.orderBy(F.desc("total_rows"), "txn_key")
    return ranked.limit(limit) if limit > 0 else ranked


def in_order(txns: DataFrame) -> DataFrame:
    return txns.orderBy("start_time", "txn_key")
