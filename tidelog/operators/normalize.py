"""Raw change events to normalised events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.numbers import halved
from tidelog.functions.sql_text import control_word, utf8_prefix
from tidelog.options import MAX_SQL_BYTES
from tidelog.schemas import EVENT

# The names event types go by, old and new.
ROW_PREFIXES = {"INSERT": ("WriteRows", "WRITE_ROWS"), "UPDATE": ("UpdateRows", "UPDATE_ROWS"), "DELETE": ("DeleteRows", "DELETE_ROWS")}
QUERY_TYPES = ("QUERY_EVENT", "QueryEvent")
ROWS_QUERY_TYPES = ("ROWS_QUERY_EVENT", "RowsQueryEvent")
XID_TYPES = ("XID_EVENT", "XIDEvent")
TABLE_MAP_TYPES = ("TABLE_MAP_EVENT", "TableMapEvent")


def affected_rows(event_type: Column, images: Column) -> Column:
    """Rows changed, given row images: an update has two for each row."""
    return F.when(F.upper(event_type).contains("UPDATE"), halved(images)).otherwise(images)


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _known() -> Column:
    """Whether an event is of a kind that the analysis knows."""
    kind = F.col("event_type")
    rows = F.lit(False)
    for first, second in ROW_PREFIXES.values():
        rows = rows | kind.startswith(first) | kind.startswith(second)
    return rows | kind.isin(*ROWS_QUERY_TYPES, *XID_TYPES, *TABLE_MAP_TYPES) | (kind.isin(*QUERY_TYPES) & control_word(_text("query")).isin("BEGIN", "COMMIT"))


def normalize(raw: DataFrame, halve_update_images: bool = False) -> DataFrame:
    """Events of the kinds the analysis knows; others are dropped.  Nulls become empty values.

    Known kinds differ in their first letter, by which they are told from here
    on: Catalyst copies these expressions into filters, and long ones would
    make methods too large to be compiled.
    """
    letter = F.substring("event_type", 1, 1)
    is_rows, is_sql = letter.isin("W", "U", "D"), letter == "R"
    event = F.when(is_rows, "ROWS").when(is_sql, "ROWS_QUERY").when(letter == "X", "XID").when(letter == "T", "TABLE_MAP").otherwise(control_word(_text("query")))
    operation = F.when(letter == "W", "INSERT").when(letter == "U", "UPDATE").when(letter == "D", "DELETE").otherwise("")
    count = F.coalesce(F.col("row_count"), F.lit(0)).cast("bigint")
    sql = _text("query_sql")
    size = F.octet_length(sql).cast("bigint")
    return raw.filter(_known()).select(
        "seq",
        "ts",
        event.alias("event_type"),
        F.lit("").alias("txn_key"),
        F.when(letter.isin("X", "R"), "").otherwise(_text("schema")).alias("schema"),
        F.when(letter.isin("X", "R", "Q"), "").otherwise(_text("table")).alias("table"),
        operation.alias("operation"),
        F.when(is_rows, affected_rows(F.col("event_type"), count) if halve_update_images else count).otherwise(0).alias("row_count"),
        F.when(is_sql, utf8_prefix(sql)).otherwise("").alias("query_sql"),
        F.when(is_sql, size > MAX_SQL_BYTES).otherwise(False).alias("query_truncated"),
        F.when(is_sql, size).otherwise(0).cast("bigint").alias("query_original_bytes"),
    )


def complete(events: DataFrame) -> DataFrame:
    """Normalised events given directly: absent columns are added, nulls become empty values."""
    empty = {"string": "", "bigint": 0, "boolean": False}
    columns = []
    for f in EVENT.fields:
        kind = f.dataType.simpleString()
        own = F.col(f"`{f.name}`").cast(f.dataType) if f.name in events.columns else F.lit(None).cast(f.dataType)
        columns.append((F.coalesce(own, F.lit(empty[kind]).cast(f.dataType)) if kind in empty and f.name != "seq" else own).alias(f.name))
    return events.select(*columns)
