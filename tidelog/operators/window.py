"""The time window, which comes before everything else."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_window(events: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Events from start to end, both included; times are UTC without a zone.  Reaches the scan as a filter."""
    if start is not None:
        events = events.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        events = events.filter(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return events
