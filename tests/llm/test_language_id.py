import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelog.llm import language_id as L

SAMPLES = {"xx": [b"abab abab abba", b"ab ba ab"], "yy": [b"cdcd cddc", b"dc dc dcd abc"]}


def tree(texts):
    """Context -> byte -> count, for contexts of up to ORDER bytes within a text."""
    out = {}
    for t in texts:
        for i, c in enumerate(t):
            for n in range(L.ORDER + 1):
                before = tuple(t[max(0, i - n) : i])
                key = (None,) * (n - len(before)) + before
                out.setdefault(key, {}).setdefault(c, 0)
                out[key][c] += 1
    return out


def law(counts, context):
    """The chance of each byte by PPM, method C; context None is the flat law below the empty context."""
    if context is None:
        return {b: 1 / 256 for b in range(256)}
    parent = law(counts, context[1:] if context else None)
    own = counts.get(context)
    if not own:
        return parent
    total, kinds = sum(own.values()), len(own)
    left = sum(p for b, p in parent.items() if b not in own)
    return {b: own[b] / (total + kinds) if b in own else p / left * kinds / (total + kinds) for b, p in parent.items()}


def brute_bits(texts, all_contexts, text):
    counts, bits = tree(texts), 0.0
    for i, c in enumerate(text):
        before = tuple(text[max(0, i - L.ORDER) : i])
        ctx = (None,) * (L.ORDER - len(before)) + before
        seen_ctx = tuple(b if b in all_contexts["bytes"] else None for b in ctx)
        while seen_ctx and seen_ctx not in all_contexts["contexts"]:
            seen_ctx = seen_ctx[1:]
        bits -= math.log2(law(counts, seen_ctx)[c])
    return bits


def test_code_lengths_are_exact(monkeypatch):
    model = L.fit(SAMPLES)
    texts = [b"abba dcd", b"", b"zzz ab\xff", b"a", b"cdcdcdcd cddc", b"ab" * 40]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    trees = {k: tree(v) for k, v in SAMPLES.items()}
    known = {"bytes": {c for v in SAMPLES.values() for t in v for c in t}, "contexts": {c for t in trees.values() for c in t}}
    want = [[brute_bits(SAMPLES[k], known, t) for t in texts] for k in model.languages]
    assert L.code_lengths(model, raw, offsets) == pytest.approx(np.array(want), rel=1e-4, abs=1e-3)
    for piece in (1, 2, 5):
        monkeypatch.setattr(L, "PIECE", piece)
        assert L.code_lengths(model, raw, offsets) == pytest.approx(np.array(want), rel=1e-4, abs=1e-3)


def test_states_are_the_same_without_their_table(monkeypatch):
    rng = random.Random(4)
    samples = {k: [bytes(rng.choices(range(256), k=4000)), bytes(rng.choices(a, k=3000))] for k, a in (("xx", b"abc "), ("yy", b"abd "))}
    whole = L.fit(samples, table_bytes=1 << 20)
    monkeypatch.setattr(L, "STATE_BYTES", 0)
    parts = L.fit(samples, table_bytes=1 << 20)
    assert whole.states is not None or whole.width == 257
    assert parts.states is None
    code = np.array([rng.randrange(parts.width**3) for _ in range(5000)] + [0])
    small = L.fit(SAMPLES)
    assert small.states is None
    monkeypatch.setattr(L, "STATE_BYTES", 1 << 30)
    assert (L.fit(samples, table_bytes=1 << 20).state(code) == parts.state(code)).all()
    code = np.arange(small.width**3)
    assert (L.fit(SAMPLES).state(code) == small.state(code)).all()


def test_long_rows_are_cut_and_the_sample_is_bounded(spark):
    rows = [(k, "lama moru tali é " * 9000, "xx") for k in range(12)] + [(k, "krz sztu gdye", "yy") for k in range(500)] + [(k, "", "zz") for k in range(400)] + [(999, "óóó ááá", "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = {}
    keep, L.fit = L.fit, lambda samples: seen.update(samples)
    try:
        L.fit_on(docs, "text", "lang", F.xxhash64("doc_id", "lang"), rows=50, row_bytes=1000, nbytes=4500)
    finally:
        L.fit = keep
    assert [len(t) for t in seen["xx"]] == [1000] * 5 and len(seen["yy"]) == 50 and seen["zz"] == ["óóó ááá".encode()]


def test_each_row_of_the_tables_is_a_law():
    model = L.fit(SAMPLES)
    p = np.exp2(-model.bits.reshape(2, -1, model.width).astype(float))
    unseen = 256 - (model.width - 1)
    assert p[:, :, 1:].sum(axis=2) + unseen * p[:, :, 0] == pytest.approx(1.0, abs=1e-4)


def test_bounded_states_still_work():
    model = L.fit(SAMPLES, table_bytes=100)
    assert L.predict(model, pa.array(["abab", "cdcd"]))[0] == ["xx", "yy"]


def test_rows(spark):
    rng = random.Random(1)
    words = {"xx": ["lama", "moru", "tali"], "yy": ["krz", "sztu", "gdye"]}
    rows = [(i, " ".join(rng.choices(words[k], k=20)), k, 9.9) for i, k in enumerate(["xx", "yy"] * 40)]
    rows += [(1, None, "xx", 0.0), (2, "", None, 0.0), (None, "lama tali", "yy", 0.0), (3, "12 34 !", "xx", 0.0), (3, "12 34 !", "xx", 0.0), (4, "krz " * 100_000, None, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score_was double")
    model = L.fit_on(docs, "text", "lang", F.xxhash64("doc_id"))
    out = L.identify(docs.select("doc_id", "text", "score_was"), model).collect()
    assert len(out) == len(rows)
    assert [r["lang_pred"] for r in out[:80]] == ["xx", "yy"] * 40
    assert [r["lang_pred"] for r in out[80:]] == ["und", "und", "xx", "und", "und", "yy"]
    assert all(0 <= r["score"] <= 1 for r in out) and out[80]["score"] == 0
    clash = L.identify(docs.selectExpr("doc_id", "text", "'s' as score", "1 as lang_pred", "2 as lettered"), model)
    assert clash.columns == ["doc_id", "lettered", "lang_pred", "score"] and [r["lang_pred"] for r in clash.collect()] == [r["lang_pred"] for r in out]
    empty = docs.limit(0)
    assert L.fit_on(empty, "text", "lang", F.xxhash64("doc_id")) is None
    assert [r["lang_pred"] for r in L.identify(docs.select("doc_id", "text"), None).collect()] == ["und"] * len(rows)
    assert L.identify(empty.select("doc_id", "text"), model).count() == 0


def test_every_language_is_learned_with_its_own_room(spark):
    rng = random.Random(3)
    own = {f"l{k:03d}": ["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(6)] for k in range(70)}
    rows = [(i, " ".join(rng.choices(own[k], k=20)), k) for k in own for i in range(6 if k < "l064" else 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit_on(docs, "text", "lang", F.xxhash64("doc_id", "lang"))
    assert sorted(k for m in [model, *model.rest] for k in m.languages) == sorted(own)
    texts = {k: " ".join(rng.choices(w, k=20)) for k, w in own.items()}
    assert L.predict(model, pa.array(list(texts.values())))[0] == list(texts)
    samples = {k: [" ".join(rng.choices(w, k=200)).encode()] for k, w in own.items()}
    some = dict(list(samples.items())[:4])
    least = min(m.bits.size // len(m.languages) // m.width for m in [L.fit(samples, table_bytes=30_000), *L.fit(samples, table_bytes=30_000).rest])
    assert least >= 0.8 * (L.fit(some, table_bytes=30_000).bits.size // 4 // L.fit(some, table_bytes=30_000).width)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", F.length("text").alias("n"))
    out = L.op1_language_id(spark, sf).join(docs, "doc_id").filter("held_out and n >= 20").collect()
    assert len(out) > 150
    assert sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.97
