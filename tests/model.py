"""A plain state machine over events, as the oracle of property tests."""

from __future__ import annotations


class Boundary(Exception):
    def __init__(self, number):
        self.number = number


def transactions(events):
    """events: dicts in order with ts (a number), event_type and the rest. Returns transactions in order of start."""
    done, now, count = [], None, 0

    def start(ts, explicit):
        nonlocal now, count
        count += 1
        now = {"key": f"txn-{count}", "start": ts, "end": ts, "rows": 0, "events": 0, "explicit": explicit, "sql": "", "tables": {}, "operations": {}}

    def close():
        nonlocal now
        done.append(now)
        now = None

    for e in events:
        t = e["event_type"]
        if t == "BEGIN":
            if now and now["explicit"]:
                raise Boundary(count)
            if now:
                close()
            start(e["ts"], True)
        elif t in ("XID", "COMMIT"):
            if now:
                if now["explicit"]:
                    now["end"] = e["ts"]
                close()
        elif t in ("ROWS", "ROWS_QUERY"):
            if not now:
                start(e["ts"], False)
            if t == "ROWS_QUERY":
                now["sql"] = e.get("query_sql", "")
                continue
            now["rows"] += e.get("row_count", 0)
            now["events"] += 1
            now["end"] = e["ts"]
            if e.get("schema") and e.get("table"):
                k = f"{e['schema']}.{e['table']}"
                now["tables"][k] = now["tables"].get(k, 0) + e["row_count"]
            if e.get("operation"):
                now["operations"][e["operation"]] = now["operations"].get(e["operation"], 0) + e["row_count"]
    if now:
        close()
    return done


def median(values):
    s = sorted(values)
    if not s:
        return 0
    h = len(s) // 2
    return s[h] if len(s) % 2 else int((s[h - 1] + s[h]) / 2)


def spikes(buckets, window, factor, least):
    """buckets: (minute, total, {table: rows}) in order. Returns (minute, table or None, rows, baseline)."""
    out = []
    for i, (minute, total, tables) in enumerate(buckets):
        if i < window:
            continue
        past = buckets[i - window : i]
        base = median([b[1] for b in past])
        if total >= least and base > 0 and total / base >= factor:
            out.append((minute, None, total, base))
        for name, rows in sorted(tables.items()):
            base = median([b[2].get(name, 0) for b in past])
            if rows >= least and base > 0 and rows / base >= factor:
                out.append((minute, name, rows, base))
    return out
