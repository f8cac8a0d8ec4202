"""How reports write times, durations, numbers and JSON."""

from __future__ import annotations

from datetime import datetime
from typing import Any


def clock(t: datetime | None) -> str:
    return "N/A" if t is None else t.strftime("%Y-%m-%d %H:%M:%S")


def rfc3339(t: datetime | None) -> str:
    return "" if t is None else t.strftime("%Y-%m-%dT%H:%M:%SZ")


def _decimal(whole: int, part: int, digits: int) -> str:
    """whole.part without trailing zeros; part has so many digits."""
    tail = f"{part:0{digits}d}".rstrip("0") if part else ""
    return f"{whole}.{tail}" if tail else str(whole)


def exact_duration(us: int) -> str:
    """Hours, minutes and seconds as far as they are needed: 14m59s, 1h0m0s, 1.5s, 250ms, 3µs."""
    sign, us = ("-", -us) if us < 0 else ("", us)
    if us == 0:
        return "0s"
    if us < 1000:
        return f"{sign}{us}µs"
    if us < 1_000_000:
        return f"{sign}{_decimal(us // 1000, us % 1000, 3)}ms"
    minutes, rest = divmod(us, 60_000_000)
    hours, minutes = divmod(minutes, 60)
    out = f"{hours}h" if hours else ""
    if hours or minutes:
        out += f"{minutes}m"
    return f"{sign}{out}{_decimal(rest // 1_000_000, rest % 1_000_000, 6)}s"


def short_duration(us: int) -> str:
    """As text reports have it: whole milliseconds under a second, one decimal under a minute, else exact."""
    if us == 0:
        return "0s"
    if us < 1_000_000:
        return f"{-(-us // 1000) if us < 0 else us // 1000}ms"
    if us < 60_000_000:
        return f"{us / 1e6:.1f}s"
    return exact_duration(us)


def _number(x: float) -> str:
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    return repr(x)


# Characters that JSON strings never hold as they are.
_ESCAPES = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f", "<": "\\u003c", ">": "\\u003e", "&": "\\u0026", "\u2028": "\\u2028", "\u2029": "\\u2029"}


def _string(s: str) -> str:
    return '"' + "".join(_ESCAPES.get(c) or (f"\\u{ord(c):04x}" if c < " " else c) for c in s) + '"'


def to_json(value: Any, indent: str = "") -> str:
    """JSON with two spaces a level; dicts keep their order, empty ones and empty lists stay on one line."""
    inner = indent + "  "
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return _string(value)
    if isinstance(value, int | float):
        return _number(value)
    if isinstance(value, datetime):
        return _string(rfc3339(value))
    if isinstance(value, dict):
        rows = [f"{inner}{_string(k)}: {to_json(v, inner)}" for k, v in value.items()]
        return "{\n" + ",\n".join(rows) + f"\n{indent}}}" if rows else "{}"
    rows = [inner + to_json(v, inner) for v in value]
    return "[\n" + ",\n".join(rows) + f"\n{indent}]" if rows else "[]"
