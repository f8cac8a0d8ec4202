import base64
import gzip
import hashlib
import random
import zlib

import duckdb
import pyarrow as pa
import pytest

from tidelog.llm import warc as W
from tidelog.llm.common import written


def pages(n=30, seed=1):
    rng = random.Random(seed)
    return [(k, f"http://h/{k}", bytes(rng.choices(b"<p>ab\r\n\xc3\xa9", k=rng.randint(0, 3000)))) for k in range(n)]


def read_all(raw):
    s = W.Salvage(pa.BufferReader(bytes(raw)))
    return [(int(r.headers["x-page-id"]), r.payload, r.at, r.length) for r in s], s.gaps


@pytest.mark.parametrize("pack", [W.packed, lambda r: r])
@pytest.mark.parametrize("step", [64, 1 << 18])
def test_whole_archive(pack, step, monkeypatch):
    monkeypatch.setattr(W, "READ", step)
    rows = pages()
    parts = [pack(W.record(*r)) for r in rows]
    got, gaps = read_all(b"".join(parts))
    assert [(i, p) for i, p, _, _ in got] == [(i, p) for i, _, p in rows] and gaps == []
    assert [n for _, _, _, n in got] == [len(p) for p in parts]
    assert read_all(b"") == ([], [])


@pytest.mark.parametrize("pack", [W.packed, lambda r: r])
@pytest.mark.parametrize("step", [64, 1 << 18])
def test_damage_costs_only_the_records_it_hits(pack, step, monkeypatch):
    monkeypatch.setattr(W, "READ", step)
    rows = pages(12)
    parts = [pack(W.record(*r)) for r in rows]
    starts = [sum(map(len, parts[:k])) for k in range(len(parts))]
    whole = b"".join(parts)
    rng = random.Random(9)
    for _ in range(60):
        raw, hit = bytearray(whole), set()
        for _ in range(rng.randint(1, 3)):
            k = rng.randrange(len(parts))
            at = starts[k] + rng.randrange(len(parts[k]))
            raw[at] ^= 1 << rng.randrange(8)
            hit.add(k)
        got, gaps = read_all(raw)
        found = {i for i, _, _, _ in got}
        assert found >= set(range(12)) - hit
        for i, p, at, _ in got:
            if i not in hit:
                assert p == rows[i][2] and at == starts[i]
        covered = sorted([(at, at + n) for _, _, at, n in got] + [(g.start, g.end) for g in gaps])
        assert covered[0][0] == 0 and covered[-1][1] == len(raw)
        assert all(a[1] == b[0] for a, b in zip(covered, covered[1:]))


@pytest.mark.parametrize("pack", [W.packed, lambda r: r])
def test_junk_and_cuts(pack):
    rows = pages(6)
    parts = [pack(W.record(*r)) for r in rows]
    raw = b"junk at first " + parts[0] + parts[1] + b"\x1f\x8b\x08 not a member WARC/1 \n" + parts[2][: len(parts[2]) // 2] + parts[3] + parts[4] + parts[5][:-9]
    got, gaps = read_all(raw)
    assert [i for i, _, _, _ in got] == [0, 1, 3, 4]
    assert sum(g.end - g.start for g in gaps) == len(raw) - sum(len(parts[k]) for k in (0, 1, 3, 4))


def test_a_long_damaged_start_costs_only_itself(monkeypatch):
    monkeypatch.setattr(W, "READ", 64)
    rows = pages(40)
    parts = [W.packed(W.record(*r)) for r in rows]
    lost = next(k for k in range(40) if sum(map(len, parts[:k])) > 20 * W.READ)
    size = sum(map(len, parts[:lost]))
    got, gaps = read_all(bytes(size) + b"".join(parts[lost:]))
    assert [i for i, _, _, _ in got] == list(range(lost, 40))
    assert [(g.start, g.end) for g in gaps] == [(0, size)]


@pytest.mark.parametrize("step", [64, 1 << 18])
def test_a_packed_body_in_a_damaged_record_does_not_hide_the_rest(step, monkeypatch):
    monkeypatch.setattr(W, "READ", step)
    rows = [(0, "u", W.packed(b"a body" * 50)), *pages(6)[1:]]
    parts = [W.record(*r) for r in rows]
    raw = bytearray(b"".join(parts))
    raw[0] ^= 1
    got, gaps = read_all(raw)
    assert [(i, p) for i, p, _, _ in got] == [(i, p) for i, _, p in rows[1:]]
    assert [(g.start, g.end) for g in gaps] == [(0, len(parts[0]))]


def test_packed_and_plain_records_in_one_archive():
    rows = pages(8)
    parts = [(W.packed if k % 2 else bytes)(W.record(*r)) for k, r in enumerate(rows)]
    raw = bytearray(b"".join(parts))
    raw[len(parts[0])] ^= 1
    got, gaps = read_all(raw)
    assert [i for i, _, _, _ in got] == [0, *range(2, 8)] and len(gaps) == 1


class Counted:
    """A source that counts the bytes read from it."""

    def __init__(self, raw, seekable=True):
        self.inner, self.taken, self.can = pa.BufferReader(raw), 0, seekable

    def read(self, n):
        got = self.inner.read(n)
        self.taken += len(got)
        return got

    def seekable(self):
        return self.can

    def __getattr__(self, name):
        return getattr(self.inner, name)


@pytest.mark.parametrize("seekable", [True, False])
def test_a_damaged_length_buffers_nothing(seekable, monkeypatch):
    monkeypatch.setattr(W, "READ", 4096)
    rows = pages(300)
    parts = [W.record(*r) for r in rows]
    raw = parts[0].replace(b"Content-Length: ", b"Content-Length: 3", 2).replace(b"X-Header-CRC32", b"X-Was-Checksum") + b"".join(parts[1:])
    source = Counted(raw, seekable)
    salvage = iter(W.Salvage(source))
    first = next(salvage)
    assert first.headers["x-page-id"] == "1"
    assert not seekable or source.taken < 20 * W.READ
    assert [r.headers["x-page-id"] for r in salvage] == [str(k) for k in range(2, 300)]


def test_records_and_headers_of_any_size():
    long = "http://h/" + "x" * (2 << 20)
    for pack in (W.packed, bytes):
        raw = pack(W.record(1, long, b"a")) + pack(W.record(2, "u", b"z" * (3 << 20))) + pack(W.record(3, "v", b""))
        salvage = W.Salvage(pa.BufferReader(raw))
        assert [(r.headers["x-page-id"], len(r.payload)) for r in salvage] == [("1", 1), ("2", 3 << 20), ("3", 0)] and not salvage.gaps


def test_damage_in_a_block_is_caught():
    plain = W.record(1, "u", b"abc").replace(b"200 OK", b"201 OK")
    got, gaps = read_all(plain + W.record(2, "u", b"x"))
    assert [i for i, _, _, _ in got] == [2] and gaps[0].reason == "digest of the block differs"


def test_revisits_say_whom_they_refer_to():
    response, revisit = W.record(9, "http://a/", b"abc"), W.record(2, "http://b/", b"abc", 9, True, "http://a/")
    told = [r.headers for r in W.Salvage(pa.BufferReader(response + revisit))]
    assert told[1]["warc-refers-to"] == told[0]["warc-record-id"]
    assert told[1]["warc-refers-to-target-uri"] == "http://a/" and told[1]["warc-refers-to-date"] == told[0]["warc-date"]


def test_damage_in_plain_headers_is_caught():
    raw = W.record(1, "u", b"abc").replace(b"X-Page-ID: 1", b"X-Page-ID: 7")
    got, gaps = read_all(raw + W.record(2, "u", b"x"))
    assert [i for i, _, _, _ in got] == [2] and gaps[0].reason == "the headers' checksum differs"


def test_a_wrong_digest_is_caught():
    raw = W.record(1, "u", b"payload").replace(b"payload", b"paYload").replace(b"WARC-Block-Digest", b"X-Was-Digest").replace(b"X-Header-CRC32", b"X-Was-Checksum")
    got, gaps = read_all(W.packed(raw) + W.packed(W.record(2, "u", b"x")))
    assert [i for i, _, _, _ in got] == [2] and gaps[0].reason == "digest differs"


def want(rows, least=0):
    best = {}
    for i, html in rows:
        key = html or ""
        if i is not None:
            best[key] = max(best.get(key, i), i)
    out = []
    for i, html in rows:
        raw = (html or "").encode()
        to = best.get(html or "") if len(raw) >= least else None
        revisit = to is not None and i != to
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
@pytest.mark.parametrize("broadcast", [0, 1 << 20])
def test_frames(spark, tmp_path, least, broadcast, monkeypatch):
    monkeypatch.setattr(W, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(W, "HOT_PAYLOADS", 1)
    rows = [(1, "<a>"), (2, "<a>"), (2, "<a>"), (3, None), (4, ""), (5, "é long page" * 20_000), (None, "<a>"), (None, "solo")] + [(k, "hot copy") for k in range(100, 160)]
    frame = spark.createDataFrame([(i, f"http://x/{i}\r\nX: y z", h, "s") for i, h in rows], "page_id long, url string, html string, sha string").repartition(3)
    files, _ = written(W.write(frame, f"file://{tmp_path}/w", least, archive_bytes=700), "t")
    assert files.count() > 3 and files.agg({"records": "sum"}).first()[0] == len(rows)
    got = W.read(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == want(rows, least)
    assert W.read(files, gaps=True).count() == 0
    classes = sorted((str(r["page_id"]), bytes(r["payload"]), r["response_id"], str(r["response_url"])) for r in W.classified(frame, least, broadcast).collect())
    assert classes == sorted((str(r["page_id"]), bytes(r["payload"]), r["response_id"], str(r["response_url"])) for r in W.classified(frame, least, 1 << 30).collect())
    assert {r["response_url"] for r in W.classified(frame, 0, broadcast).filter("page_id = 100").collect()} == {"http://x/159\r\nX: y z"}
    path = files.first()["path"].removeprefix("file://")
    raw = bytearray(open(path, "rb").read())
    raw[12] ^= 255
    open(path, "wb").write(raw)
    assert W.read(files, gaps=True).count() == 1
    none, _ = written(W.write(frame.limit(0), f"file://{tmp_path}/n"), "t")
    assert W.read(none).count() == 0


def test_readable_by_others(tmp_path):
    raw = W.packed(W.record(1, "http://x/", b"abc")) + W.packed(W.record(2, "http://y/", b"abc", 1, True))
    assert gzip.decompress(raw).count(b"WARC/1.1") == 2
    assert zlib.crc32(raw)


def test_query_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = sorted(map(tuple, W.op4_warc(spark, sf).collect()), key=str)
    assert got == want(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    assert sorted(con.execute(W.OP4_SQL).fetchall(), key=str) == got
