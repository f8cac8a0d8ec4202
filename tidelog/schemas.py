"""Row types of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_LONG, _TEXT, _TIME, _FLAG = T.LongType(), T.StringType(), T.TimestampNTZType(), T.BooleanType()

#: A change event as a source gives it. seq is the total order of events over all files.
RAW_EVENT = _struct(file_idx=T.IntegerType(), seq=_LONG, ts=_TIME, event_type=_TEXT, schema=_TEXT, table=_TEXT, query=_TEXT, query_sql=_TEXT, row_count=_LONG, pos=_LONG)

#: A normalised event: BEGIN, COMMIT, XID, TABLE_MAP, ROWS or ROWS_QUERY.
EVENT = _struct(seq=_LONG, ts=_TIME, event_type=_TEXT, txn_key=_TEXT, schema=_TEXT, table=_TEXT, operation=_TEXT, row_count=_LONG, query_sql=_TEXT, query_truncated=_FLAG, query_original_bytes=_LONG)

#: The result tables, by name.
RESULT_TABLES = {
    "transactions": _struct(txn_key=_TEXT, start_time=_TIME, end_time=_TIME, duration_ms=_LONG, total_rows=_LONG, event_count=_LONG, query_summary=_TEXT, query_truncated=_FLAG, query_original_bytes=_LONG),
    "transaction_tables": _struct(txn_key=_TEXT, table_key=_TEXT, rows=_LONG),
    "transaction_sql_contexts": _struct(txn_key=_TEXT, query_sql=_TEXT, query_truncated=_FLAG, query_original_bytes=_LONG),
    "transaction_operations": _struct(txn_key=_TEXT, operation=_TEXT, rows=_LONG),
    "minute_buckets": _struct(minute=_TIME, total_rows=_LONG, txn_count=_LONG),
    "minute_table_rows": _struct(minute=_TIME, table_key=_TEXT, rows=_LONG),
    "alerts": _struct(type=_TEXT, severity=_TEXT, txn_key=_TEXT, minute=_TIME, message=_TEXT, details_json=_TEXT),
}
