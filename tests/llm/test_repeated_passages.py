import hashlib
import random

import numpy as np
import pytest

from tidelog.llm import repeated_passages as R


def brute(rows, length):
    """rows: (id, text) in corpus order."""
    first, marks = {}, []
    for k, (_, text) in enumerate(rows):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            if first.setdefault(raw[s : s + length], (k, s)) != (k, s):
                gone[s : s + length] = True
        marks.append(gone)
    out = []
    for (d, text), gone in zip(rows, marks):
        raw = (text or "").encode()
        left = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0
        out.append((d, len(raw), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


def texts(seed, n=40):
    rng = random.Random(seed)
    passages = ["".join(rng.choices("abcdé ", k=rng.randint(90, 300))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choices("abcdefgh ", k=rng.randint(1, 200))))
            if rng.random() < 0.3:
                p = rng.choice(passages)
                a = rng.randrange(len(p))
                parts.append(p[a : a + rng.randint(80, 130)])
        out.append("".join(parts))
    out += ["a" * 350, "ab" * 120, "a" * 99, "a" * 100, "", out[0], out[0]]
    rng.shuffle(out)
    return out


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("setup", ["plain", "again", "shuffled"])
def test_frames(spark, setup):
    rows = [(k * 3, t) for k, t in enumerate(texts(len(setup)))] + [(1, None)]
    ordered = sorted(rows, key=lambda r: r[0])
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, part string").repartition(6)
    if setup == "shuffled":
        own = R.numbered(docs)
        spans = R.repeats(own, broadcast_bytes=0)
        out = R.cut(own, spans, 1, broadcast_bytes=0)
    else:
        out = R.remove_repeats(docs)
    assert sorted(rows_of(out)) == sorted(brute(ordered, 100))


def test_kernels_in_pieces(monkeypatch):
    raw = [t.encode() for t in texts(3)]
    whole = [R.phrases(np.frombuffer(r, np.uint8)) for r in raw]
    every, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    row, trigger, start, count, mark = R.batch_phrases(every, offsets)
    for k, (t, s, n, f) in enumerate(whole):
        own = row == k
        assert (trigger[own] == t).all() and (start[own] == s).all() and (count[own] == n).all() and (mark[own] == f).all()
        assert (n & (R.AGAIN - 1)).sum() == max(0, len(raw[k]) - 99)
    monkeypatch.setattr(R, "PIECE", 64)
    plain = R.AGAIN - 1
    for r, (t, s, n, _) in zip(raw, whole):
        t2, s2, n2, _ = R.phrases(np.frombuffer(r, np.uint8))
        assert (np.repeat(t2, n2 & plain) == np.repeat(t, n & plain)).all()
    row2, trigger2, _, count2, _ = R.batch_phrases(every, offsets)
    assert (np.repeat(trigger2, count2 & plain) == np.repeat(trigger, count & plain)).all()


def test_phrases_that_repeat_themselves_are_marked():
    rng = random.Random(8)
    for _ in range(300):
        d = rng.choice([1, 2, 7, 40, 68, 69, 70, 99, 130])
        unit = "".join(rng.choices("abcdefg", k=d))
        body = (unit * 400)[: 100 + d + rng.choice([0, 0, 1, 30])]
        text = ("".join(rng.choices("hijkl", k=rng.randint(0, 150))) + body + "".join(rng.choices("mnop", k=rng.randint(0, 150)))).encode()
        t, s, n, _ = R.phrases(np.frombuffer(text, np.uint8))
        for k in range(len(t)):
            w = n[k] & (R.AGAIN - 1)
            own = [text[i : i + 100] for i in range(s[k], s[k] + w)]
            if len(set(own)) < len(own):
                assert n[k] & R.AGAIN


def test_a_part_too_large_is_passed_on(monkeypatch):
    blocks = R._blocks_by_part(np.array([1, 1, 0, 1]), [(np.array([5, 5, 7, 9]), "<u4"), (np.array([1, 1, 2, 3]), "<u8"), (np.arange(4), "<i8"), (np.zeros(4), "<u4"), (np.ones(4), "<u4")])
    more = [blocks, blocks.slice(1)]
    parts = [(p, len(a[0]), s) for p, a, s in R._each_part(iter(more), R._PHRASE, 3)]
    assert parts == [(0, 1, False), (1, 3, True), (1, 3, True)]


def test_repeated_and_null_ids(spark):
    p = "".join(random.Random(1).choices("abcdef", k=150))
    rows = [(1, p), (1, p), (None, p + "x"), (2, "y" + p), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(R.remove_repeats(docs))
    assert sorted(g[2] for g in got) == [0, 0, 150, 150, 150]
    assert sum(g[2] for g in got if g[0] is None) == 0
    assert R.remove_repeats(docs.limit(0)).count() == 0
    kept = R.remove_repeats(spark.createDataFrame([(1, p), (2, "é" + p)], "doc_id long, text string"), keep_text=True).collect()
    assert {r["doc_id"]: bytes(r["kept"]).decode() for r in kept} == {1: p, 2: "é"}


def test_hot_triggers_are_split_by_window(spark, monkeypatch):
    """As with very many phrases of one trigger, told by their count."""
    rows = list(enumerate(texts(11)))
    own = R.numbered(spark.createDataFrame(rows, "doc_id long, text string"))
    parts = 16
    found = R.dictionary(R.parse(own, parts), parts).cache()
    from pyspark.sql import functions as F

    todo = found.filter("triggers is not null").withColumn("strings", F.lit(R.SPLIT * 7)).groupBy("doc").agg(F.collect_list(F.struct("a", "b", "triggers", "strings")).alias("phrases"))
    seen = R.windows(own.join(todo, "doc").select("doc", "text", "phrases"), parts)
    gone = found.unionByName(R.ordered(seen)).filter("triggers is null")
    spans = gone.groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    assert sorted(rows_of(R.cut(own, spans, 1))) == sorted(brute(rows, 100))


def test_long_phrases_weigh_as_many(spark, monkeypatch):
    """A text that repeats itself is a phrase or two of any length; its windows are dealt out."""
    rows = [(k, ("ab" * 3000 if k % 2 else "abc" * 2500) + f" end {k}") for k in range(6)] + [(9, "x" * 5000), (10, "y" + "x" * 4000)]
    own = R.numbered(spark.createDataFrame(rows, "doc_id long, text string"))
    found = R.dictionary(R.parse(own, 4), 4).filter("triggers is not null").collect()
    assert max(r["strings"] for r in found) > 20
    monkeypatch.setattr(R, "SPLIT", 5)
    assert sorted(rows_of(R.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")))) == sorted(brute(rows, 100))


def test_equal_windows_meet_in_a_part_that_comes_in_pieces(spark, monkeypatch):
    """Pieces of a part differ in their count of a trigger's phrases, each above 2 * SPLIT."""
    rng = random.Random(5)

    def noise(n):
        return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))

    grams = [noise(R.GRAM) for _ in range(20_000)]
    raw = np.frombuffer("".join(grams).encode(), np.uint8)
    at = np.arange(len(grams)) * R.GRAM
    core = grams[int(np.argmin(R._substrings(R._sums(raw), at, at + R.GRAM)))]
    shared = [noise(45) + core + noise(45) for _ in range(5)]
    rows = [(k, noise(80) + (rng.choice(shared) if k % 3 == 0 else noise(45) + core + noise(45)) + noise(80)) for k in range(420)]
    parts, counts = 4, []
    monkeypatch.setattr(R, "COMBINE", 16)
    monkeypatch.setattr(R, "SPLIT", 4)
    monkeypatch.setattr(R, "PIECE", 6000)
    each = R._each_part

    def told(blocks):
        for _, (trigger, *_), split in each(iter(blocks), R._PHRASE, 8 * R.COMBINE):
            if split:
                counts.append(int(np.bincount(np.unique(trigger, return_inverse=True)[1]).max()))

    own = R.numbered(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    blocks = R.parse(own, parts).cache()
    told(blocks.filter("data is not null").sort("part").toArrow().to_batches())
    assert len({c // R.SPLIT for c in counts if c > 2 * R.SPLIT}) > 1
    found = R.dictionary(blocks, parts).cache()
    todo = found.filter("triggers is not null").groupBy("doc").agg(R.F.collect_list(R.F.struct("a", "b", "triggers", "strings")).alias("phrases"))
    seen = R.windows(own.join(todo, "doc").select("doc", "text", "phrases"), parts)
    gone = found.unionByName(R.ordered(seen)).filter("triggers is null")
    spans = gone.groupBy("doc").agg(R.F.collect_list(R.F.struct("a", "b")).alias("spans"))
    assert sorted(rows_of(R.cut(own, spans, 1))) == sorted(brute(rows, 100))


def test_windows_of_a_hot_trigger_go_to_parts_of_bounded_size(spark, monkeypatch):
    """A common line between texts that differ: one trigger, and far more bytes of windows than of phrases."""
    rng = random.Random(6)

    def noise(n):
        return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))

    grams = [noise(R.GRAM) for _ in range(20_000)]
    raw = np.frombuffer("".join(grams).encode(), np.uint8)
    at = np.arange(len(grams)) * R.GRAM
    line = grams[int(np.argmin(R._substrings(R._sums(raw), at, at + R.GRAM)))]
    rows = [(k, noise(120) + line + noise(120)) for k in range(500)]
    monkeypatch.setattr(R, "SPLIT", 100)
    parts = 4096
    own = R.numbered(spark.createDataFrame(rows, "doc_id long, text string"))
    found = R.dictionary(R.parse(own, parts), parts).filter("triggers is not null").cache()
    assert max(r["strings"] for r in found.collect()) >= 400
    todo = found.groupBy("doc").agg(R.F.collect_list(R.F.struct("a", "b", "triggers", "strings")).alias("phrases")).cache()
    seen = R.windows(own.join(todo, "doc").select("doc", "text", "phrases"), parts).filter("data is not null")
    sizes = [r[1] for r in seen.groupBy("part").agg(R.F.sum(R.F.length("data"))).collect()]
    assert sum(sizes) > 10 * R.SPLIT * R.PHRASE_BYTES and max(sizes) <= 4 * R.SPLIT * R.PHRASE_BYTES
    assert R.ranked_parts(todo, 3) == 3
    monkeypatch.setattr(R, "RANKED", 1 << 14)
    assert 16 < R.ranked_parts(todo, 3) < 500
    assert sorted(rows_of(R.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")))) == sorted(brute(rows, 100))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = sorted(rows_of(R.op6_repeated_passages(spark, sf)))
    want = sorted(brute(rows, 100))
    assert got == want
    assert sum(w[2] for w in want) > 0
