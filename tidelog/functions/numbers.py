"""Expressions on times, counts and short integer lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_quotient(a: Column, b: int) -> Column:
    """Of whole numbers, cut towards zero."""
    return F.call_function("div", a, F.lit(b))


def minute_of(ts: Column) -> Column:
    return F.date_trunc("minute", ts).cast("timestamp_ntz")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def millis_between(start: Column, end: Column) -> Column:
    """Whole milliseconds, cut towards zero; negative if end is first."""
    return whole_quotient(micros(end) - micros(start), 1000)


def halved(n: Column) -> Column:
    return whole_quotient(n, 2)


def median_of_sorted(values: Column, n: int) -> Column:
    """The median of n sorted whole numbers: of an even number the mean of the middle two, cut towards zero."""
    if n <= 0:
        return F.lit(0).cast("bigint")
    high = F.element_at(values, n // 2 + 1)
    return high if n % 2 else whole_quotient(F.element_at(values, n // 2) + high, 2)


def sorted_map(key: Column, value: Column) -> Column:
    """An aggregate: the map of distinct keys, in their order."""
    return F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value))))
