import random

import pytest

from tests import model
from tests.events import at, ev, rows
from tests.test_transactions import random_events
from tidelog.operators.stats import minute_buckets, minute_table_rows, table_stats
from tidelog.operators import alerts
from tidelog.operators.normalize import complete
from tidelog.options import AnalysisOptions
from tidelog.schemas import EVENT
from tidelog.streaming import live

STREAMED = EVENT.simpleString()


def frame(spark, events, first=0):
    named = [{n: e.get(n) for n in EVENT.names} | {"seq": first + k} for k, e in enumerate(events)]
    return complete(spark.createDataFrame(named, EVENT))


def feed(spark, tmp_path, batches, stream_id=False):
    """A stream of files, one a batch, in order."""
    folder, first = str(tmp_path / "in"), 0
    for k, events in enumerate(batches):
        part = frame(spark, events, first)
        if stream_id:
            part = part.selectExpr("'a' as stream_id", "*").union(part.selectExpr("'b' as stream_id", "*"))
        part.coalesce(1).write.mode("append").parquet(f"{folder}/{k:03d}")
        first += len(events)
    schema = spark.read.parquet(f"{folder}/000").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def drain(stream, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query


BATCHES = [[rows(5, 1, txn="t1"), rows(3, 20, "shop.users", txn="t1")], [rows(2, 59, operation="DELETE", txn="t2"), rows(4, 70, txn="t3")], [rows(1, 200, txn="t4")], [rows(1, 400, txn="t5")]]


def test_minutes_and_tables(spark, tmp_path):
    every = frame(spark, [e for b in BATCHES for e in b])
    stream = feed(spark, tmp_path, BATCHES)
    drain(live.live_table_stats(stream), "tables_live", "complete")
    assert sorted(map(tuple, spark.table("tables_live").collect())) == sorted(map(tuple, table_stats(every).collect()))
    closed = at(240)
    for batch, streamed, name in ((minute_buckets, live.live_minute_buckets, "minutes_live"), (minute_table_rows, live.live_minute_table_rows, "rows_live")):
        drain(streamed(stream, "30 seconds"), name, "append")
        want = [tuple(r) for r in batch(every).collect() if r["minute"] < closed]
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(want)


@pytest.mark.parametrize("seed", range(3))
def test_transactions(spark, tmp_path, seed):
    rng = random.Random(seed)
    while True:
        events = random_events(rng, 40) + [ev("XID", 501), ev("BEGIN", 502), ev("XID", 503)]
        try:
            want = model.transactions(events)
            break
        except model.Boundary:
            continue
    stream = feed(spark, tmp_path, [events[:9], events[9:30], events[30:]], stream_id=True)
    drain(live.live_transactions(stream), f"txns_live_{seed}", "append")
    got = spark.table(f"txns_live_{seed}").collect()
    for name in "ab":
        own = [(r["txn_key"], r["start_time"], r["end_time"], r["total_rows"], r["event_count"], r["query_sql"]) for r in got if r["stream_id"] == name]
        assert own == [(t["key"], t["start"], t["end"], t["rows"], t["events"], t["sql"]) for t in want]


def test_two_begins(spark, tmp_path):
    stream = feed(spark, tmp_path, [[ev("BEGIN", 0), rows(1, 1)], [ev("BEGIN", 2), ev("XID", 3)]], stream_id=True)
    drain(live.live_transactions(stream), "errors_live", "append")
    told = [r["error"] for r in spark.table("errors_live").filter("stream_id = 'a'").collect()]
    assert told == ["BEGIN received while explicit transaction txn-1 is in-flight", ""]


def test_spikes(spark, tmp_path):
    batches = [[rows(n, 60 * k)] for k, n in enumerate((10, 12, 120, 11, 10, 500, 1, 1, 1))]
    options, found = AnalysisOptions(detect_spikes=True, spike_window=2, spike_min_rows=50), []
    watch = live.spike_watch(str(tmp_path / "past"), options, lambda alerts, _: found.extend((r["minute"], r["rows"], r["baseline"]) for r in alerts.collect()))
    query = live.live_minute_buckets(feed(spark, tmp_path, batches), "1 second").writeStream.foreachBatch(watch).outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert found == [(at(120), 120, 11), (at(300), 500, 10)]


def test_table_spikes_and_bounded_history(spark, tmp_path):
    counts = {"shop.a": (10, 12, 120, 11, 10, 9, 10, 1, 1, 1), "shop.b": (0, 0, 5, 400, 3, 4, 700, 1, 1, 1)}
    batches = [[rows(n, 60 * k, table) for table, own in counts.items() if (n := own[k])] for k in range(10)]
    options, found = AnalysisOptions(detect_spikes=True, spike_window=2, spike_min_rows=50, spike_factor=3.0), []
    past = tmp_path / "past"
    watch = live.table_spike_watch(str(past), options, lambda alerts, _: found.extend((r["minute"], r["table"], r["rows"], r["baseline"]) for r in alerts.collect()))
    stream = feed(spark, tmp_path, batches)
    query = live.live_minute_table_rows(stream, "1 second").writeStream.foreachBatch(watch).outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    every = frame(spark, [e for b in batches for e in b])
    buckets, by_table = minute_buckets(every), minute_table_rows(every)
    want = alerts.spike_alerts(buckets, options).unionByName(alerts.table_spike_alerts(buckets, by_table, options))
    assert sorted(found, key=str) == sorted(((r["minute"], r["table"], r["rows"], r["baseline"]) for r in want.collect()), key=str)
    assert any(t for _, t, _, _ in found) and any(t is None for _, t, _, _ in found)
    assert len([p for p in past.iterdir() if p.name.startswith("after=")]) <= 2


def test_a_batch_run_again_says_the_same(spark, tmp_path):
    options, told = AnalysisOptions(detect_spikes=True, spike_window=1, spike_min_rows=5, spike_factor=2.0), []
    watch = live.spike_watch(str(tmp_path / "h"), options, lambda found, n: told.append((n, [r["rows"] for r in found.collect()])))
    minutes = [spark.createDataFrame([(at(60 * k), n, 0)], "minute timestamp_ntz, total_rows long, txn_count long") for k, n in enumerate((5, 20, 4))]
    for k in (0, 1, 1, 2, 2):
        watch(minutes[k], k)
    assert told == [(0, []), (1, [20]), (1, [20]), (2, []), (2, [])]


def test_table_stats_without_transactions(spark, tmp_path):
    stream = feed(spark, tmp_path, BATCHES)
    drain(live.live_table_stats(stream, count_txns=False), "tables_lean", "complete")
    assert "txn_count" not in spark.table("tables_lean").columns and spark.table("tables_lean").count() == 2
