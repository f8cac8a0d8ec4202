import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm import decontaminate as D

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text):
    words = WORD.findall(lower(text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def words(text):
    return WORD.findall(lower(text or ""))


def brute(docs, items, percent=80):
    out = []
    for i, d in docs:
        s, own = shingles(d), words(d)
        for j, t in items:
            q, run = shingles(t), words(t)
            if 0 < len(run) < 5:
                if any(own[k : k + len(run)] == run for k in range(len(own) - len(run) + 1)):
                    out.append((i, j, 1, 1))
            elif q and 100 * len(q & s) >= percent * len(q):
                out.append((i, j, len(q), len(q & s)))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r[0], r[1], r[2], r[3]) for r in df.collect()), key=str)


WORDS = st.lists(st.sampled_from("a b C d é".split()), max_size=14).map(" ".join)


@settings(max_examples=80, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=5), st.lists(st.one_of(st.none(), WORDS), min_size=1, max_size=5))
def test_matches_random(items, texts):
    import pyarrow as pa

    index = D.build(list(range(len(items))), items)
    got = sorted((r, index.ids[i], len(index.sets[i]), n) for r, i, n in D.matches(index, pa.array(texts, pa.string())))
    assert got == sorted(brute(list(enumerate(texts)), list(enumerate(items))))


def test_tables(spark):
    item = " ".join(f"w{k}" for k in range(30))
    near = item.replace("w3 ", "W3 ").replace("w29", "other")
    far = " ".join(f"w{k}" if k % 4 else "x" for k in range(30))
    long = "pad " * 50_000 + item + " pad" * 50_000
    docs = [(1, "before " + item + " after", "u"), (1, "before " + item + " after", "u"), (2, None, "u"), (3, "", "u"), (4, near, "u"), (5, far, "u"), (None, long, None), (6, "two words", "u")]
    items = [(10, item), (10, item), (11, None), (None, "two Words"), (12, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute([r[:2] for r in docs], items)
    assert rows(D.leaks(d, b)) == want
    assert rows(D.leaks(d, b, limit=40)) == want  # by shuffles
    for limit in (D.BLOCK_BYTES, 40):
        kept = D.drop_leaks(d, b, limit=limit)
        assert kept.columns == d.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 5]
    assert D.leaks(d.limit(0), b).count() == 0
    assert D.leaks(d, b.limit(0)).count() == 0 and D.drop_leaks(d, b.limit(0)).count() == len(docs)


@pytest.mark.parametrize("limit", [D.BLOCK_BYTES, 0])
def test_items_of_every_length(spark, limit):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(n * 10 + k, " ".join(rng.choices(vocabulary, k=n))) for n in (1, 2, 3, 4, 5, 6, 9, 40) for k in range(4)]
    texts = []
    for _ in range(60):
        parts = rng.choices(vocabulary, k=rng.randint(0, 60))
        if rng.random() < 0.6:
            own = rng.choice(items)[1].split()
            if rng.random() < 0.4 and len(own) > 8:
                own[rng.randrange(len(own))] = "odd"
            at = rng.randint(0, len(parts))
            parts[at:at] = own
        texts.append(" ".join(parts).title())
    docs = list(enumerate(texts)) + [(100, "The quick brown fox"), (101, "see the quick\n brown FOX jump")]
    items.append((900, "the quick brown fox"))
    want = brute(docs, items)
    assert {10, 20, 30, 40, 900} <= {j // 10 * 10 if j < 900 else j for _, j, _, _ in want}
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert rows(D.leaks(d, b, limit=limit)) == want
    assert sorted(r["doc_id"] for r in D.drop_leaks(d, b, limit=limit).collect()) == sorted({i for i, _ in docs} - {r[0] for r in want})


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = brute(docs, items)
    assert rows(D.op10_decontaminate(spark, sf)) == want
    assert want
