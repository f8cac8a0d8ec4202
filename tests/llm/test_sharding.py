import hashlib
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm import sharding as S


def brute_least(sizes, shards):
    """Dynamic programming over all contiguous partitions."""
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        best = [min([max(best[i], sum(sizes[i:j])) for i in range(j + 1)]) for j in range(len(sizes) + 1)]
    return best[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=12), st.integers(1, 5))
def test_least_capacity(sizes, shards):
    assert S.least_capacity(sizes, shards) == brute_least(sizes, shards)


def shares_of(sizes, shards):
    capacity = S.least_capacity(sizes, shards)
    ends, _ = S.even_cuts(sizes, capacity, shards)
    bounds = [0, *ends, len(sizes)]
    assert len(bounds) == shards + 1 and bounds == sorted(bounds)
    return capacity, [sum(sizes[a:b]) for a, b in zip(bounds, bounds[1:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=40), st.integers(1, 9))
def test_even_cuts_keep_the_capacity_and_fill_every_shard(sizes, shards):
    capacity, shares = shares_of(sizes, shards)
    assert max(shares, default=0) <= capacity
    assert sum(1 for s in shares if s) == min(shards, len(sizes))


def test_even_cuts_are_even():
    capacity, shares = shares_of([1] * 1000 + [500] + [1] * 1000, 16)
    assert capacity == 500 == max(shares)
    rest = sorted(shares)[:-1]
    assert rest[0] >= 62 and sum(rest) == 2000 and rest[1] >= 120 and rest[-1] <= 160
    for sizes in ([1] * 997, [1, 2, 3, 4, 5] * 200, [7] * 16 + [1] * 300):
        _, shares = shares_of(sizes, 16)
        assert max(shares) - min(shares) <= 2 * max(sizes)


def expected(rows, shards):
    groups = defaultdict(int)
    for _, t in rows:
        groups["null" if t is None else hashlib.md5(t.encode()).hexdigest()] += (len(t.encode()) if t else 0) + 1
    return groups, S.least_capacity([groups[k] for k in sorted(groups)], shards)


@pytest.mark.parametrize("digits", [1, 3])
def test_parts_taken_apart(spark, digits, monkeypatch):
    import random

    rng = random.Random(digits)
    rows = [(k, "x" * rng.randint(0, 400) + str(rng.randint(0, 150))) for k in range(400)] + [(k, "hot") for k in range(200)]
    groups, least = expected(rows, 7)
    table = spark.createDataFrame(list(groups.items()), "key string, size long")
    firsts = S.partition(table, 7, digits)
    shares = defaultdict(int)
    for k, size in groups.items():
        shares[sum(k >= f for f in firsts)] += size
    assert max(shares.values()) == least
    assert len(shares) == 7 and min(shares.values()) >= sum(groups.values()) / 7 - max(groups.values())


def test_a_huge_group_leaves_no_shard_empty(spark):
    groups = [(f"{k:032x}", 1) for k in range(0, 16**3 * 300, 617)]
    groups.insert(700, (groups[700][0][:-1] + "z", 900))
    table = spark.createDataFrame(groups, "key string, size long")
    for digits in (3, 31):
        firsts = S.partition(table, 16, digits)
        shares = defaultdict(int)
        for k, size in groups:
            shares[sum(k >= f for f in firsts)] += size
        assert len(shares) == 16 and max(shares.values()) == 900
        assert sorted(shares.values())[1] > 100


def check(rows, got, shards):
    groups, least = expected(rows, shards)
    assert sorted((str(d), -1 if t is None else zlib.crc32(t.encode())) for d, t in rows) == sorted((str(r["doc_id"]), -1 if r["text_crc32"] is None else r["text_crc32"]) for r in got)
    by_text, slots, sizes = defaultdict(set), defaultdict(list), defaultdict(int)
    for r in got:
        by_text[r["text_crc32"], r["size"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values(), default=0) == least
    assert len(sizes) == min(shards, len(groups))


def test_frame(spark):
    rows = [(1, "a"), (1, "a"), (2, None), (3, None), (None, ""), (4, "é" * 50_000), (5, "b")] + [(k, f"text {k % 40}") for k in range(6, 200)] + [(k, "hot copy " * 5) for k in range(200, 400)]
    docs = spark.createDataFrame([(d, t, "size", 3) for d, t in rows], "doc_id long, text string, key string, shard int")
    check(rows, S.assign(docs).collect(), 16)
    check(rows, S.assign(docs, shards=3).collect(), 3)
    assert S.assign(docs.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(rows, S.op3_sharding(spark, sf).collect(), 16)
