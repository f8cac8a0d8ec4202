"""What an analysis may be asked: window, limits, thresholds, presentation."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from datetime import UTC, datetime, timedelta
from enum import Enum

# Bounds of the SQL kept with a transaction, and of its summary.
MAX_SQL_BYTES = 4096
MAX_SUMMARY_CHARS = 160


class SqlContext(str, Enum):
    """How much of a transaction's SQL a report shows."""

    SUMMARY = "summary"
    OFF = "off"
    FULL = "full"

    @classmethod
    def parse(cls, text: str) -> SqlContext:
        """The mode of a command line value; the empty one is the default."""
        try:
            return cls(text or "summary")
        except ValueError:
            raise ValueError(f'invalid --sql-context "{text}" (allowed: summary, off, full)') from None

    @classmethod
    def or_default(cls, value: object) -> SqlContext:
        """As renderers take it: anything unknown is the default."""
        try:
            return cls(value)
        except ValueError:
            return cls.SUMMARY


class TxnKeys(str, Enum):
    """Which key counts as an event's transaction in table and minute statistics."""

    INPUT = "input"
    RECONSTRUCTED = "reconstructed"


@dataclass(frozen=True)
class AnalysisOptions:
    """Both window ends are inclusive. A limit of 0 or less is none; a threshold of 0 or less is off."""

    start: datetime | None = None
    end: datetime | None = None
    top_tables: int = 20
    top_transactions: int = 20
    large_txn_rows: int = 1000
    large_txn_duration: timedelta = timedelta(seconds=30)
    detect_spikes: bool = False
    spike_window: int = 5
    spike_factor: float = 5.0
    spike_min_rows: int = 100
    txn_keys: TxnKeys = TxnKeys.INPUT
    halve_update_images: bool = False

    @classmethod
    def unlimited(cls, **changes) -> AnalysisOptions:
        """No limits and no alerts, but for what is changed."""
        bare = cls(top_tables=0, top_transactions=0, large_txn_rows=0, large_txn_duration=timedelta(0), spike_window=0, spike_factor=0.0, spike_min_rows=0)
        return replace(bare, **changes)

    def naive_start(self) -> datetime | None:
        return _naive(self.start)

    def naive_end(self) -> datetime | None:
        return _naive(self.end)


def _naive(t: datetime | None) -> datetime | None:
    """In UTC without a zone, as event times are."""
    return t.astimezone(UTC).replace(tzinfo=None) if t is not None and t.tzinfo else t


_RFC3339 = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)")


def parse_time(text: str, what: str) -> datetime | None:
    """An RFC 3339 time, or None if empty."""
    if not text:
        return None
    try:
        if not _RFC3339.fullmatch(text):
            raise ValueError(text)
        whole = re.sub(r"(\.\d{6})\d+", r"\1", text)
        return datetime.fromisoformat(whole)
    except ValueError:
        raise ValueError(f'invalid {what} time "{text}": RFC3339 expected') from None


def parse_time_range(start: str, end: str) -> tuple[datetime | None, datetime | None]:
    a, b = parse_time(start, "start"), parse_time(end, "end")
    if a and b and b < a:
        raise ValueError("end time must be after start time")
    return a, b


_UNITS = {"h": 3_600_000_000, "m": 60_000_000, "s": 1_000_000, "ms": 1000, "us": 1, "µs": 1, "ns": 0.001}
_PART = re.compile(r"(\d+(?:\.\d*)?|\.\d+)(ms|us|µs|ns|h|m|s)")


def parse_duration(text: str) -> timedelta:
    """A duration such as 30s, 1m30s or 500ms."""
    body = text.lstrip("+-") if text[:1] in "+-" else text
    if body == "0":
        return timedelta(0)
    parts = _PART.findall(body)
    if not parts or "".join(n + u for n, u in parts) != body:
        raise ValueError(f'invalid duration "{text}"')
    total = timedelta(microseconds=sum(float(n) * _UNITS[u] for n, u in parts))
    return -total if text[:1] == "-" else total
