"""DuckDB SQL that says what the catalog's queries return, independent of how they are run."""

from __future__ import annotations

from datetime import datetime, timedelta

from tidelog.options import AnalysisOptions
from tidelog.sources.adapters import RAW_KINDS, RAW_QUERIES

ACTIVITY = """
ev AS (
  SELECT event_id AS seq, ts,
         CASE event_type WHEN 'error' THEN 'XID' WHEN 'view' THEN 'ROWS_QUERY' ELSE 'ROWS' END AS event_type,
         'u' || user_id AS txn_key,
         CASE WHEN event_type IN ('error', 'view') THEN '' ELSE 'app' END AS schema,
         CASE WHEN event_type IN ('error', 'view') THEN '' ELSE 't' || (user_id % 8) END AS "table",
         CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'purchase' THEN 'UPDATE' WHEN 'click' THEN 'DELETE' ELSE '' END AS operation,
         CASE WHEN event_type IN ('error', 'view') THEN 0 ELSE coalesce(CAST(floor(value) AS BIGINT), 0) END AS row_count,
         CASE WHEN event_type = 'view' THEN coalesce(props, '') ELSE '' END AS query_sql
  FROM events)"""

ORDERS = """
items AS (
  SELECT l_orderkey AS key, l_shipdate AS ts, l_returnflag AS flag, l_partkey, CAST(l_quantity AS BIGINT) AS row_count,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_shipdate) AS place
  FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
raw AS (
  SELECT key * {span} + place AS seq, ts, CASE flag WHEN 'A' THEN 'WRITE_ROWS_EVENTv2' WHEN 'N' THEN 'UPDATE_ROWS_EVENTv2' ELSE 'DELETE_ROWS_EVENTv2' END AS raw_type,
         'ROWS' AS event_type, 'shop' AS schema, 'p' || (l_partkey % 16) AS "table",
         CASE flag WHEN 'A' THEN 'INSERT' WHEN 'N' THEN 'UPDATE' ELSE 'DELETE' END AS operation, row_count FROM items
  UNION ALL SELECT o_orderkey * {span}, o_orderdate, 'QUERY_EVENT', 'BEGIN', '', '', '', 0 FROM orders
  UNION ALL SELECT o_orderkey * {span} + {span} - 1, coalesce((SELECT max(ts) FROM items i WHERE i.key = o_orderkey), o_orderdate), 'XID_EVENT', 'XID', '', '', '', 0 FROM orders),
ev AS (SELECT seq, ts, event_type, '' AS txn_key, schema, "table", operation, row_count, '' AS query_sql FROM raw)"""

#: A raw log: names of event types and texts of queries in order, by event_id and user_id.
RAW = """
rawlog AS (
  SELECT event_id AS seq, ts, {kinds}[event_id % {n_kinds} + 1] AS raw_type, 'app' AS schema, 't' || (user_id % 8) AS "table",
         coalesce(CAST(floor(value) AS BIGINT), 0) AS n, {queries}[user_id % {n_queries} + 1] AS query,
         CASE WHEN user_id % 5 > 0 THEN repeat(coalesce(props, '') || ' é', CAST(event_id % 97 * 8 AS BIGINT)) ELSE '' END AS sql
  FROM events),
classed AS (
  SELECT *, CASE WHEN raw_type LIKE 'WriteRows%' OR raw_type LIKE 'WRITE\\_ROWS%' ESCAPE '\\' THEN 'INSERT'
                 WHEN raw_type LIKE 'UpdateRows%' OR raw_type LIKE 'UPDATE\\_ROWS%' ESCAPE '\\' THEN 'UPDATE'
                 WHEN raw_type LIKE 'DeleteRows%' OR raw_type LIKE 'DELETE\\_ROWS%' ESCAPE '\\' THEN 'DELETE' ELSE '' END AS op,
         upper(regexp_replace(query, '^[\\s\\x0b\\p{{Z}}]+|[\\s\\x0b\\p{{Z}}]+$', '', 'g')) AS word
  FROM rawlog),
kinded AS (
  SELECT *, CASE WHEN op <> '' THEN 'ROWS' WHEN raw_type IN ('XIDEvent', 'XID_EVENT') THEN 'XID' WHEN raw_type IN ('TableMapEvent', 'TABLE_MAP_EVENT') THEN 'TABLE_MAP'
                 WHEN raw_type IN ('RowsQueryEvent', 'ROWS_QUERY_EVENT') THEN 'ROWS_QUERY'
                 WHEN raw_type IN ('QueryEvent', 'QUERY_EVENT') AND word IN ('BEGIN', 'COMMIT') THEN word END AS kind
  FROM classed),
ev AS (
  SELECT seq, ts, kind AS event_type, '' AS txn_key, CASE WHEN kind IN ('XID', 'ROWS_QUERY') THEN '' ELSE schema END AS schema,
         CASE WHEN kind IN ('ROWS', 'TABLE_MAP') THEN "table" ELSE '' END AS "table", op AS operation, CASE WHEN kind = 'ROWS' THEN n ELSE 0 END AS row_count,
         CASE WHEN kind <> 'ROWS_QUERY' THEN '' WHEN strlen(sql) <= {most} THEN sql
              ELSE left(sql, (SELECT max(k) FROM range({least}, {most} + 1) r(k) WHERE strlen(left(sql, k)) <= {most})) END AS query_sql,
         kind = 'ROWS_QUERY' AND strlen(sql) > {most} AS query_truncated, CASE WHEN kind = 'ROWS_QUERY' THEN strlen(sql) ELSE 0 END AS query_original_bytes
  FROM kinded WHERE kind IS NOT NULL)"""

#: After ev: events with txn_id, and a row a transaction.
TXNS = """
kinds AS (
  SELECT *, CASE event_type WHEN 'BEGIN' THEN 'B' WHEN 'COMMIT' THEN 'C' WHEN 'XID' THEN 'C' ELSE 'R' END AS kind
  FROM {ev} WHERE event_type IN ('BEGIN', 'COMMIT', 'XID', 'ROWS', 'ROWS_QUERY')),
lagged AS (SELECT *, coalesce(lag(kind) OVER (ORDER BY seq), 'C') AS before FROM kinds),
numbered AS (
  SELECT *, CAST(sum(CASE WHEN kind = 'B' OR (kind = 'R' AND before = 'C') THEN 1 ELSE 0 END) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS txn_id
  FROM lagged),
assigned AS (SELECT * FROM numbered WHERE NOT (kind = 'C' AND before = 'C')),
told AS (
  SELECT txn_id, 'txn-' || txn_id AS txn_key, min_by(kind, seq) = 'B' AS explicit, bool_or(kind = 'C') AS closed,
         min_by(ts, seq) AS start_time, max_by(ts, seq) AS last_time,
         max_by(ts, seq) FILTER (WHERE event_type = 'ROWS') AS last_rows_time,
         CAST(coalesce(sum(row_count) FILTER (WHERE event_type = 'ROWS'), 0) AS BIGINT) AS total_rows,
         count(*) FILTER (WHERE event_type = 'ROWS') AS event_count,
         coalesce(max_by(query_sql, seq) FILTER (WHERE event_type = 'ROWS_QUERY'), '') AS query_sql
  FROM assigned GROUP BY txn_id),
ended AS (SELECT *, CASE WHEN explicit AND closed THEN last_time ELSE coalesce(last_rows_time, start_time) END AS end_time FROM told),
txns AS (
  SELECT txn_key, start_time, end_time, CAST(trunc((epoch_us(end_time) - epoch_us(start_time)) / 1000) AS BIGINT) AS duration_ms,
         total_rows, event_count, {summary} AS query_summary, query_sql, false AS query_truncated, CAST(strlen(query_sql) AS BIGINT) AS query_original_bytes
  FROM ended)"""

FLAT = "txn_key, start_time, end_time, duration_ms, total_rows, event_count, query_summary, query_truncated, query_original_bytes"

STATS = """
SELECT schema, "table", CAST(sum(row_count) AS BIGINT) AS total_rows,
       CAST(sum(CASE WHEN operation = 'INSERT' THEN row_count ELSE 0 END) AS BIGINT) AS insert_rows,
       CAST(sum(CASE WHEN operation = 'UPDATE' THEN row_count ELSE 0 END) AS BIGINT) AS update_rows,
       CAST(sum(CASE WHEN operation = 'DELETE' THEN row_count ELSE 0 END) AS BIGINT) AS delete_rows,
       count(DISTINCT CASE WHEN txn_key <> '' THEN txn_key END) AS txn_count
FROM {ev} WHERE operation IN ('INSERT', 'UPDATE', 'DELETE') AND schema <> '' AND "table" <> ''
GROUP BY schema, "table" """

MINUTES = """
active AS (SELECT *, date_trunc('minute', ts) AS minute, schema || '.' || "table" AS table_key FROM ev WHERE schema <> '' AND "table" <> '' AND row_count <> 0),
buckets AS (SELECT minute, CAST(sum(row_count) AS BIGINT) AS total_rows, count(DISTINCT CASE WHEN txn_key <> '' THEN txn_key END) AS txn_count FROM active GROUP BY minute),
by_table AS (SELECT minute, table_key, CAST(sum(row_count) AS BIGINT) AS rows FROM active GROUP BY minute, table_key)"""


def _summary(column: str) -> str:
    """White space runs to one space, trimmed, 157 characters and an ellipsis if over 160."""
    line = f"regexp_replace(regexp_replace({column}, '[ \\t\\n\\r]+', ' ', 'g'), '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g')"
    return f"CASE WHEN length({line}) > 160 THEN left({line}, 157) || '...' ELSE {line} END"


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _spikes(o: AnalysisOptions) -> str:
    n = o.spike_window
    return f"""
placed AS (SELECT *, row_number() OVER (ORDER BY minute) - 1 AS place FROM buckets),
windowed AS (SELECT *, list_sort(list(total_rows) OVER (ORDER BY place ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)) AS past FROM placed),
based AS (SELECT *, past[{n // 2 + 1}] AS baseline FROM windowed WHERE place >= {n}),
overall AS (SELECT minute, total_rows AS rows, baseline, total_rows / CAST(baseline AS DOUBLE) AS factor FROM based
            WHERE total_rows >= {o.spike_min_rows} AND baseline > 0 AND total_rows / CAST(baseline AS DOUBLE) >= {o.spike_factor})"""


def _table_spikes(o: AnalysisOptions) -> str:
    n = o.spike_window
    return f"""
tplaced AS (SELECT minute, row_number() OVER (ORDER BY minute) - 1 AS place FROM buckets),
trows AS (SELECT t.table_key, t.rows, t.minute, p.place FROM by_table t JOIN tplaced p USING (minute)),
tseen AS (SELECT *, coalesce(list(rows) OVER (PARTITION BY table_key ORDER BY place RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING), []) AS seen FROM trows),
tbased AS (SELECT *, list_sort(list_concat(list_transform(range({n} - len(seen)), lambda x: CAST(0 AS BIGINT)), seen))[{n // 2 + 1}] AS baseline FROM tseen WHERE place >= {n}),
by_tables AS (SELECT minute, table_key, rows, baseline, rows / CAST(baseline AS DOUBLE) AS factor FROM tbased
              WHERE rows >= {o.spike_min_rows} AND baseline > 0 AND rows / CAST(baseline AS DOUBLE) >= {o.spike_factor})"""


def _large(o: AnalysisOptions) -> str:
    rows, ms = o.large_txn_rows, o.large_txn_duration // timedelta(milliseconds=1)
    return f"""
named AS (SELECT 'txn-' || txn_id AS txn_key, string_agg(DISTINCT schema || '.' || "table", ',' ORDER BY schema || '.' || "table") AS tables
          FROM assigned WHERE event_type = 'ROWS' AND schema <> '' AND "table" <> '' GROUP BY txn_id),
large AS (SELECT txn_key, 'warning' AS severity,
                 'Transaction ' || txn_key || ' ' || concat_ws(' and ', CASE WHEN total_rows > {rows} THEN 'exceeds row threshold' END, CASE WHEN duration_ms > {ms} THEN 'exceeds duration threshold' END) AS message,
                 total_rows AS rows, duration_ms, event_count,
                 CASE WHEN total_rows > {rows} THEN CAST({rows} AS BIGINT) END AS rows_threshold,
                 CASE WHEN duration_ms > {ms} THEN CAST({ms} AS BIGINT) END AS duration_threshold_ms, tables
          FROM txns LEFT JOIN named USING (txn_key) WHERE total_rows > {rows} OR duration_ms > {ms})"""


def statements(start: datetime, end: datetime, limit: int, sql_bytes: int, spikes: AnalysisOptions, table_spikes: AnalysisOptions, span: int) -> dict[str, str]:
    plain = AnalysisOptions(detect_spikes=True)
    orders = ORDERS.format(span=span)
    txns = TXNS.format(ev="ev", summary=_summary("query_sql"))
    cut = f"cut AS (SELECT * FROM ev WHERE ts >= TIMESTAMP '{start}' AND ts <= TIMESTAMP '{end}')"
    cut_txns = TXNS.format(ev="cut", summary=_summary("query_sql"))
    columns = 'seq, ts, event_type, schema, "table", operation, CAST(row_count AS BIGINT) AS row_count'
    ranked = 'ORDER BY total_rows DESC, schema, "table" LIMIT 5'
    names = "string_agg(DISTINCT {0}, ',' ORDER BY {0})"
    raw = RAW.format(kinds=_list(RAW_KINDS), queries=_list(RAW_QUERIES), n_kinds=len(RAW_KINDS), n_queries=len(RAW_QUERIES), most=sql_bytes, least=sql_bytes // 4)
    span_of_file = 1 << 44
    files = f"two AS (SELECT * REPLACE (seq % 2 * {span_of_file} + seq AS seq) FROM ev WHERE event_type NOT IN ('BEGIN', 'COMMIT'))"
    over_files = TXNS.format(ev="two", summary="''")
    stored = AnalysisOptions(detect_spikes=True, large_txn_rows=spikes.large_txn_rows, large_txn_duration=spikes.large_txn_duration)
    cut_minutes = MINUTES.replace("FROM ev WHERE", "FROM cut WHERE")
    whole = f"WITH {ACTIVITY}, {cut}, {cut_txns}, {cut_minutes}"
    return {
        "window_filter": f"WITH {ACTIVITY}, {cut} SELECT {columns} FROM cut",
        "normalize_events": f"WITH {orders} SELECT {columns} FROM raw",
        "affected_row_counts": f"WITH {orders} SELECT seq, raw_type AS event_type, CAST(row_count AS BIGINT) AS row_count, CAST(CASE WHEN operation = 'UPDATE' THEN row_count // 2 ELSE row_count END AS BIGINT) AS affected FROM raw WHERE event_type = 'ROWS'",
        "table_stats_all": f"WITH {ACTIVITY} {STATS.format(ev='ev')}",
        "table_stats_orders": f"WITH {orders} {STATS.format(ev='ev')}",
        "table_stats_reconstructed": f"WITH {ACTIVITY}, {txns}, keyed AS (SELECT e.* REPLACE (coalesce('txn-' || a.txn_id, '') AS txn_key) FROM ev e LEFT JOIN assigned a ON a.seq = e.seq) {STATS.format(ev='keyed')}",
        "top_tables": f"WITH {ACTIVITY} {STATS.format(ev='ev')} {ranked}",
        "top_tables_windowed": f"WITH {ACTIVITY}, {cut} {STATS.format(ev='cut')} {ranked}",
        "minute_buckets": f"WITH {ACTIVITY}, {MINUTES} SELECT * FROM buckets",
        "minute_table_rows": f"WITH {ACTIVITY}, {MINUTES} SELECT * FROM by_table",
        "minute_activity": f"WITH {ACTIVITY}, {MINUTES} SELECT minute, total_rows, txn_count, (SELECT string_agg(table_key || '=' || rows, ',' ORDER BY table_key) FROM by_table t WHERE t.minute = b.minute) AS table_rows FROM buckets b",
        "transactions_implicit": f"WITH {ACTIVITY}, {txns} SELECT {FLAT} FROM txns",
        "transactions_explicit": f"WITH {orders}, {txns} SELECT {FLAT} FROM txns",
        "transactions_windowed": f"WITH {ACTIVITY}, {cut}, {cut_txns} SELECT {FLAT} FROM txns",
        "top_transactions": f"WITH {orders}, {txns} SELECT {FLAT} FROM txns ORDER BY total_rows DESC, txn_key LIMIT {limit}",
        "top_transaction_sql": f"WITH {ACTIVITY}, {txns}, top AS (SELECT * FROM txns ORDER BY total_rows DESC, txn_key LIMIT {limit}) SELECT txn_key, total_rows, CASE WHEN query_sql <> '' THEN query_sql END AS query_sql, CASE WHEN query_sql <> '' THEN query_truncated END AS query_truncated, CASE WHEN query_sql <> '' THEN query_original_bytes END AS query_original_bytes FROM top",
        "transaction_tables": f"""WITH {ACTIVITY}, {txns} SELECT 'txn-' || txn_id AS txn_key, schema || '.' || "table" AS table_key, CAST(sum(row_count) AS BIGINT) AS rows FROM assigned WHERE event_type = 'ROWS' AND schema <> '' AND "table" <> '' GROUP BY ALL""",
        "transaction_operations": f"WITH {orders}, {txns} SELECT 'txn-' || txn_id AS txn_key, operation, CAST(sum(row_count) AS BIGINT) AS rows FROM assigned WHERE event_type = 'ROWS' AND operation <> '' GROUP BY ALL",
        "transaction_sql_contexts": f"WITH {ACTIVITY}, {txns} SELECT txn_key, query_sql, query_truncated, query_original_bytes FROM txns WHERE query_sql <> ''",
        "query_summaries": f"SELECT doc_id, {_summary("coalesce(text, '')")} AS query_summary FROM documents",
        "query_contexts": f"""SELECT doc_id, CASE WHEN strlen(text) <= {sql_bytes} THEN text ELSE left(text, (SELECT max(k) FROM range({sql_bytes // 4}, {sql_bytes + 1}) r(k) WHERE strlen(left(text, k)) <= {sql_bytes})) END AS query_sql,
 strlen(text) > {sql_bytes} AS query_truncated, CAST(strlen(text) AS BIGINT) AS query_original_bytes FROM documents WHERE text <> ''""",
        "workload_summary": f"""WITH {ACTIVITY}, {txns} SELECT (SELECT count(*) FROM txns) AS total_transactions, (SELECT CAST(coalesce(sum(total_rows), 0) AS BIGINT) FROM txns) AS total_rows,
 count(*) AS total_events, min(ts) AS start_time, max(ts) AS end_time, coalesce(epoch_us(max(ts)) - epoch_us(min(ts)), 0) AS duration_us FROM ev""",
        "large_txn_alerts": f"WITH {ACTIVITY}, {txns}, {_large(spikes)} SELECT txn_key, severity, message, rows, duration_ms, event_count, rows_threshold, duration_threshold_ms, tables FROM large",
        "spike_alerts_overall": f"WITH {ACTIVITY}, {MINUTES}, {_spikes(plain)} SELECT minute, 'Write spike detected' AS message, rows, baseline, factor FROM overall",
        "spike_alerts_table": f"""WITH {ACTIVITY}, {MINUTES}, {_table_spikes(table_spikes)} SELECT minute, 'Table write spike detected' AS message, table_key AS "table", rows, baseline, factor FROM by_tables""",
        "alerts_all": f"""WITH {ACTIVITY}, {txns}, {MINUTES}, {_large(spikes)}, {_spikes(spikes)}, {_table_spikes(table_spikes)}
SELECT 'large_transaction' AS type, severity, txn_key, CAST(NULL AS TIMESTAMP) AS minute, message, CAST(NULL AS VARCHAR) AS "table", rows FROM large
UNION ALL SELECT 'spike', 'warning', '', minute, 'Write spike detected', NULL, rows FROM overall
UNION ALL SELECT 'spike', 'warning', '', minute, 'Table write spike detected', table_key, rows FROM by_tables""",
        "normalize_raw_kinds": f"WITH {raw} SELECT seq, event_type, schema, \"table\", operation, CAST(row_count AS BIGINT) AS row_count, query_sql, query_truncated, CAST(query_original_bytes AS BIGINT) AS query_original_bytes FROM ev",
        "normalized_kinds": f"WITH {raw} SELECT raw_type AS event_type, coalesce(kind, '') AS kind, count(*) AS events, CAST(coalesce(sum(CASE WHEN kind = 'ROWS' THEN CASE WHEN op = 'UPDATE' THEN n // 2 ELSE n END ELSE 0 END), 0) AS BIGINT) AS rows FROM kinded GROUP BY ALL",
        "transactions_over_files": f"""WITH {raw}, {files}, {over_files}, sized AS (SELECT 'txn-' || txn_id AS key, max_by(query_original_bytes, seq) AS size, max_by(query_truncated, seq) AS cut FROM assigned WHERE event_type = 'ROWS_QUERY' GROUP BY txn_id)
SELECT txn_key, start_time, end_time, duration_ms, total_rows, event_count, coalesce(cut, false) AS query_truncated, CAST(coalesce(size, 0) AS BIGINT) AS query_original_bytes FROM txns LEFT JOIN sized ON key = txn_key""",
        "boundary_error": f"WITH {raw}, {txns}, wrong AS (SELECT min(txn_id) AS number FROM ended WHERE explicit AND NOT closed AND txn_id < (SELECT max(txn_id) FROM ended)) SELECT number, 'BEGIN received while explicit transaction txn-' || number || ' is in-flight' AS message FROM wrong WHERE number IS NOT NULL",
        "first_transactions": f"WITH {ACTIVITY}, {txns} SELECT {FLAT} FROM txns ORDER BY start_time, txn_key LIMIT {limit}",
        "store_transactions": f"{whole} SELECT {FLAT} FROM txns",
        "store_transaction_tables": f"""{whole} SELECT 'txn-' || txn_id AS txn_key, schema || '.' || "table" AS table_key, CAST(sum(row_count) AS BIGINT) AS rows FROM assigned WHERE event_type = 'ROWS' AND schema <> '' AND "table" <> '' GROUP BY ALL""",
        "store_transaction_sql_contexts": f"{whole} SELECT txn_key, query_sql, query_truncated, query_original_bytes FROM txns WHERE query_sql <> ''",
        "store_transaction_operations": f"{whole} SELECT 'txn-' || txn_id AS txn_key, operation, CAST(sum(row_count) AS BIGINT) AS rows FROM assigned WHERE event_type = 'ROWS' AND operation <> '' GROUP BY ALL",
        "store_minute_buckets": f"{whole} SELECT * FROM buckets",
        "store_minute_table_rows": f"{whole} SELECT * FROM by_table",
        "store_alerts": f"""{whole}, {_large(stored)}, {_spikes(stored)}, {_table_spikes(stored)}
SELECT 'large_transaction' AS type, severity, txn_key, CAST(NULL AS TIMESTAMP) AS minute, message FROM large
UNION ALL SELECT 'spike', 'warning', '', minute, 'Write spike detected' FROM overall
UNION ALL SELECT 'spike', 'warning', '', minute, 'Table write spike detected' FROM by_tables""",
        "analysis_top_transactions": f"""WITH {ACTIVITY}, {cut}, {cut_txns}, top AS (SELECT * FROM txns ORDER BY total_rows DESC, txn_key LIMIT {limit})
SELECT t.txn_key, t.total_rows, t.event_count,
 coalesce((SELECT {names.format("schema || '.' || " + '"table"')} FROM assigned a WHERE 'txn-' || a.txn_id = t.txn_key AND event_type = 'ROWS' AND schema <> '' AND "table" <> ''), '') AS tables,
 coalesce((SELECT {names.format("operation")} FROM assigned a WHERE 'txn-' || a.txn_id = t.txn_key AND event_type = 'ROWS' AND operation <> ''), '') AS operations
FROM top t""",
    }
