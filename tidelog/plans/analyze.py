"""The whole analysis: one normalised input, five lazy results."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tidelog.operators import alerts as A
from tidelog.operators import stats as S
from tidelog.operators import transactions as T
from tidelog.operators.normalize import complete, normalize
from tidelog.operators.window import in_window
from tidelog.options import AnalysisOptions, TxnKeys
from tidelog.schemas import RESULT_TABLES


@dataclass
class AnalysisResult:
    """Lazy results. transactions are the top ones, with their SQL; all_* are the whole tables."""

    summary: DataFrame
    tables: DataFrame
    transactions: DataFrame
    minutes: DataFrame
    alerts: DataFrame
    all_transactions: DataFrame
    transaction_tables: DataFrame
    transaction_operations: DataFrame
    minute_table_rows: DataFrame
    minute_buckets: DataFrame
    warnings: int = 0
    held: list[DataFrame] = field(default_factory=list)

    def relational(self) -> dict[str, DataFrame]:
        """The result tables by name, with the columns of RESULT_TABLES."""
        frames = {
            "transactions": self.all_transactions,
            "transaction_tables": self.transaction_tables,
            "transaction_sql_contexts": T.sql_contexts(self.all_transactions),
            "transaction_operations": self.transaction_operations,
            "minute_buckets": self.minute_buckets,
            "minute_table_rows": self.minute_table_rows,
            "alerts": self.alerts.withColumn("details_json", A.details_json()),
        }
        return {name: f.select(*RESULT_TABLES[name].names) for name, f in frames.items()}

    def write_parquet(self, folder: str, mode: str = "errorifexists") -> None:
        for name, frame in self.relational().items():
            frame.write.mode(mode).parquet(f"{folder.rstrip('/')}/{name}")

    def release(self) -> None:
        for frame in self.held:
            frame.unpersist()


def analyze(events: DataFrame, options: AnalysisOptions | None = None, run: int = T.RUN, hold: bool = False) -> AnalysisResult:
    """Analyses normalised events.

    The window comes first, so a transaction cut by it is rebuilt from what is
    left.  Raises TransactionBoundaryError at once if a BEGIN came while an
    explicit transaction was open, whatever results are asked for.  With
    ``hold`` the transactions are persisted, as several results read them;
    release() lets them go.  Events are never held: each result reads them anew
    and only the columns it needs.
    """
    options = options or AnalysisOptions()
    events = in_window(complete(events), options.naive_start(), options.naive_end())
    held = []
    assigned = T.assign_transactions(events, run, T.STRETCH)
    txns = T.transactions(assigned)
    if hold:
        txns = txns.persist()
        held.append(txns)
    try:
        T.check_boundaries(txns)
    except Exception:
        for frame in held:
            frame.unpersist()
        raise
    counted = S.with_reconstructed_keys(events, assigned) if options.txn_keys == TxnKeys.RECONSTRUCTED else events
    txn_tables, txn_operations = T.transaction_tables(assigned), T.transaction_operations(assigned)
    buckets, table_rows = S.minute_buckets(counted), S.minute_table_rows(counted)
    alerts = A.large_transaction_alerts(txns, txn_tables, options)
    if options.detect_spikes:
        alerts = alerts.unionByName(A.spike_alerts(buckets, options)).unionByName(A.table_spike_alerts(buckets, table_rows, options))
    top = T.top_transactions(txns, options.top_transactions)
    wanted = top.select("txn_key")
    in_top = lambda frame: frame.join(wanted, "txn_key", "left_semi")
    return AnalysisResult(
        summary=S.workload_summary(events, txns),
        tables=S.top_tables(S.table_stats(counted), options.top_tables),
        transactions=T.top_transactions(T.with_maps(top, in_top(txn_tables), in_top(txn_operations)), 0),
        minutes=S.with_table_map(buckets, table_rows),
        alerts=A.in_order(alerts),
        all_transactions=T.in_order(txns),
        transaction_tables=txn_tables,
        transaction_operations=txn_operations,
        minute_table_rows=table_rows,
        minute_buckets=buckets.orderBy("minute"),
        held=held,
    )


def analyze_raw(raw: DataFrame, options: AnalysisOptions | None = None, run: int = T.RUN, hold: bool = False) -> AnalysisResult:
    """Analyses raw change events; those of unknown kinds are dropped and not counted."""
    options = options or AnalysisOptions()
    events = in_window(raw, options.naive_start(), options.naive_end())  # on the scan, before anything is computed
    return analyze(normalize(events, options.halve_update_images), options, run, hold)


def analyze_rows(spark, rows: list[dict], options: AnalysisOptions | None = None) -> AnalysisResult:
    """Analyses a list of events, each a dict; the order of the list is the order of events."""
    from tidelog.schemas import EVENT

    numbered = [{name: row.get(name) for name in EVENT.names} | {"seq": k} for k, row in enumerate(rows)]
    return analyze(spark.createDataFrame(numbered, EVENT), options)


