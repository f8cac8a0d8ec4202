"""Expressions on SQL text: control words, bounded prefixes, one-line summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.options import MAX_SQL_BYTES, MAX_SUMMARY_CHARS


def trimmed(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def control_word(query: Column) -> Column:
    return F.upper(trimmed(query))


def utf8_prefix(text: Column, most: int = MAX_SQL_BYTES) -> Column:
    """The longest prefix of whole characters within so many bytes of UTF-8."""
    raw = F.encode(text, "utf-8")
    cuts = [F.try_validate_utf8(F.substring(raw, 1, n).cast("string")) for n in range(most, most - 4, -1)]
    return F.when(F.octet_length(text) <= most, text).otherwise(F.coalesce(*cuts))


def query_summary(text: Column, most: int = MAX_SUMMARY_CHARS) -> Column:
    """On one line, cut to so many characters with an ellipsis."""
    line = trimmed(F.regexp_replace(text, r"[ \t\n\r]+", " "))
    return F.when(F.length(line) > most, F.concat(F.left(line, F.lit(most - 3)), F.lit("..."))).otherwise(line)


def query_context(sql: Column) -> Column:
    """Struct of bounded SQL, whether it was cut, and its size; null without SQL."""
    size = F.octet_length(sql).cast("bigint")
    return F.when(sql != "", F.struct(utf8_prefix(sql).alias("sql"), (size > MAX_SQL_BYTES).alias("truncated"), size.alias("original_bytes")))
