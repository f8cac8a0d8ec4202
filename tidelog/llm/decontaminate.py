"""Benchmark decontamination by size-partitioned MinHash containment search.

An item's shingle set is short, a document's long.  Items are partitioned by
set size; an item's MinHash sketch is the k least hashes of its set, where k
is fixed per size partition so that a document holding at least the threshold
share of the item's shingles must hold one of them (the rest of the set is too
small).  Documents look up their shingles in the sketches of each partition;
the candidates found are verified by exact shingle containment.

A benchmark of up to ``BLOCK_BYTES`` of text goes to the tasks as one index,
and the documents are scanned once, nothing being shuffled.  Of a larger one
the sketches are joined with the documents' shingles by hash, after a filter
of bounded size, and the candidates' shingles are counted by another join; the
results are the same.

Words and shingles are those of op2: A-Z lower-cased, five words.  An item of
fewer words is contained in a document where all its words occur in a row, its
sketch being that one run.  Null and empty texts, of items or
documents, have no shingles and match nothing.  Repeated rows are each
reported; null ids are carried along; an empty table on either side gives no
pairs; other columns are ignored, or kept as they are by :func:`drop_leaks`.
A very long text is looked up whole, its shingles taking some numbers a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidelog.llm import wordhash as W
from tidelog.llm.common import fresh, map_batches, named_rows, tables, written

PERCENT = 80
BLOCK_BYTES = 8 << 20
_FILTER_BITS = 20


@dataclass
class Partition:
    """Items of one size class: their sketch hashes, sorted, and the item of each."""

    hashes: np.ndarray
    items: np.ndarray


@dataclass
class Index:
    """partitions: of the items of whole shingles; short[m]: of the items of m words, fewer than a shingle has."""

    ids: list
    sets: list[np.ndarray]
    needed: list[int]
    partitions: list[Partition]
    maybe: np.ndarray
    short: dict[int, Partition]


def needed_of(n: int, percent: int = PERCENT) -> int:
    return -(-percent * n // 100)


def sketch_width(n: int, percent: int = PERCENT) -> int:
    """The least hashes kept of a set of n, fixed for its size partition, sizes from 2 ** b to below 2 ** (b + 1)."""
    largest = (1 << n.bit_length()) - 1
    return largest - needed_of(largest, percent) + 1


def item_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(words, ascending shingle hashes) of each item; words counts up to a shingle's."""
    raw, offsets = W.utf8_buffer(column)
    _, _, first = W.word_hashes(raw, offsets)
    yield from zip(np.minimum(np.diff(first), W.SHINGLE_WORDS).tolist(), W.shingle_sets(column), strict=True)


def _sorted(hashes: list[np.ndarray], items: list[int]) -> Partition:
    every = np.concatenate(hashes)
    owner = np.repeat(items, [len(h) for h in hashes])
    order = np.argsort(every, kind="stable")
    return Partition(every[order], owner[order])


def build(ids: list, texts: list[str | None], percent: int = PERCENT) -> Index:
    found = [(i, m, s) for i, (m, s) in zip(ids, item_sets(pa.array(texts, pa.string())), strict=True) if len(s)]
    sets = [s for _, _, s in found]
    groups: dict[tuple[int, int], list[int]] = {}
    for k, (_, m, s) in enumerate(found):
        groups.setdefault((m, len(s).bit_length()), []).append(k)
    partitions, short = [], {}
    for (m, _), members in sorted(groups.items()):
        part = _sorted([sets[k][: sketch_width(len(sets[k]), percent)] for k in members], members)
        if m < W.SHINGLE_WORDS:
            short[m] = part
        else:
            partitions.append(part)
    maybe = np.zeros(1 << _FILTER_BITS, dtype=bool)
    for p in partitions:
        maybe[p.hashes >> np.uint64(64 - _FILTER_BITS)] = True
    return Index([i for i, _, _ in found], sets, [needed_of(len(s), percent) for s in sets], partitions, maybe, short)


def _runs_of(words: np.ndarray, first: np.ndarray, n: int, maybe: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the runs of n words within a row; with ``maybe`` only of those whose highest bits it has."""
    runs = W.window_hashes(words, n)
    at = np.arange(len(runs)) if maybe is None else np.flatnonzero(maybe[runs >> np.uint64(64 - _FILTER_BITS)])
    row = np.searchsorted(first, at, side="right") - 1
    whole = at + n <= first[row + 1]
    return row[whole], runs[at[whole]]


def _pairs(part: Partition, rows: np.ndarray, keys: np.ndarray) -> set[tuple[int, int]]:
    low, high = np.searchsorted(part.hashes, keys), np.searchsorted(part.hashes, keys, side="right")
    return {(int(rows[k]), int(i)) for k in np.flatnonzero(high > low).tolist() for i in part.items[low[k] : high[k]]}


def matches(index: Index, column: pa.Array) -> Iterator[tuple[int, int, int]]:
    """(row, item, shingles shared) for each row that contains an item."""
    if not index.sets:
        return
    raw, offsets = W.utf8_buffer(column)
    words, _, first = W.word_hashes(raw, offsets)
    n = W.SHINGLE_WORDS
    rows, keys = _runs_of(words, first, n, index.maybe)
    found = set().union(*(_pairs(p, rows, keys) for p in index.partitions))
    own: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint64))
    for r, i in sorted(found):
        if own[0] != r:
            own = r, np.unique(W.window_hashes(words[first[r] : first[r + 1]], n))
        shared = int(np.isin(index.sets[i], own[1], assume_unique=True).sum())
        if shared >= index.needed[i]:
            yield r, i, shared
    for m, part in index.short.items():
        for r, i in sorted(_pairs(part, *_runs_of(words, first, m))):
            yield r, i, 1


def _items(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    return benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).filter("t is not null")


def index_of(benchmark: DataFrame, item: str = "item_id", text: str = "text", limit: int = BLOCK_BYTES) -> Index | None:
    """The benchmark's index, or None if its text is over the limit."""
    items = _items(benchmark, item, text)
    if (items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) > limit:
        return None
    got = sorted(items.collect(), key=lambda r: (r["i"] is None, r["i"], r["t"]))
    return build([r["i"] for r in got], [r["t"] for r in got])


def contained(docs: DataFrame, benchmark: DataFrame, row: str, item: str = "item_id", text: str = "text") -> DataFrame:
    """(doc, i, size, shared) for a benchmark of any size, by shuffles.  row: a column of docs that tells its rows apart."""
    spark = docs.sparkSession
    numbered = _items(benchmark, item, text).withColumn("k", F.monotonically_increasing_id())

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        told = list(item_sets(batch.column("t")))
        hashes = [s.view(np.int64) for _, s in told]
        sketch = [h[: sketch_width(len(h))] for h in hashes]
        longs = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("k"), batch.column("i"), pa.array([m for m, _ in told], pa.int64()), pa.array(hashes, longs), pa.array(sketch, longs)], names=["k", "i", "m", "hashes", "sketch"])

    kind = benchmark.select(item).schema[0].dataType.simpleString()
    items, _ = written(map_batches(numbered, sets, f"k bigint, i {kind}, m bigint, hashes array<bigint>, sketch array<bigint>", "t").filter("size(hashes) > 0"), "items")
    sketches = items.select("k", "m", F.explode("sketch").alias("hash"))
    high = F.shiftrightunsigned("hash", 64 - _FILTER_BITS)
    filters: dict[int, np.ndarray] = {}
    for r in sketches.select("m", high.alias("high")).distinct().collect():  # at most words in a shingle times 2 ** _FILTER_BITS
        filters.setdefault(r["m"], np.zeros(1 << _FILTER_BITS, dtype=bool))[r["high"]] = True
    shared = spark.sparkContext.broadcast(filters)
    texts = docs.select(F.col(f"`{row}`").alias("doc"), F.col(f"`{text}`").alias("t"))
    doc_kind = texts.schema["doc"].dataType.simpleString()

    def hits(batch: pa.RecordBatch, only: bool) -> pa.RecordBatch:
        raw, offsets = W.utf8_buffer(batch.column("t"))
        words, _, first = W.word_hashes(raw, offsets)
        rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for m, maybe in shared.value.items():
            r, h = _runs_of(words, first, m, maybe if only else None)
            order = np.lexsort((h, r))
            r, h = r[order], h[order]
            new = np.ones(len(r), dtype=bool)
            new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
            rows.append(r[new])
            hashes.append(h[new])
        return pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(hashes).view(np.int64))], names=["doc", "hash"])

    ddl = f"doc {doc_kind}, hash bigint"
    met = map_batches(texts, lambda b: hits(b, True), ddl, "t").join(sketches.select("k", "hash"), "hash").select("doc", "k").distinct()
    candidates, _ = written(met, "item-candidates")
    near = texts.join(candidates.select("doc").distinct(), "doc", "left_semi")
    held = map_batches(near, lambda b: hits(b, False), ddl, "t")
    wanted = candidates.join(items.select("k", F.explode("hashes").alias("hash")), "k")
    both = wanted.join(held, ["doc", "hash"]).groupBy("doc", "k").agg(F.count("*").alias("shared"))
    size = F.size("hashes").cast("bigint")
    return both.join(items.select("k", "i", size.alias("size")), "k").filter(100 * F.col("shared") >= PERCENT * F.col("size")).select("doc", "i", "size", "shared")


def leaks(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", limit: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document and item it contains: ids, shingles of the item, how many are shared, containment."""
    index = index_of(benchmark, item, text, limit)
    if index is None:
        own, row = named_rows(docs, doc, text)
        found = contained(own, benchmark, row, item, text)
        ids = own.select(F.col(f"`{row}`").alias("doc"), F.col(f"`{doc}`").alias("named"))
        containment = (F.col("shared") / F.col("size")).alias("containment")
        return found.join(ids, "doc").select(F.col("named").alias(doc), F.col("i").alias(item), F.col("size").alias("item_shingles"), F.col("shared").alias("shared_shingles"), containment)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kinds = f"{doc} {docs.schema[doc].dataType.simpleString()}, {item} {benchmark.schema[item].dataType.simpleString()}, item_shingles bigint, shared_shingles bigint, containment double"
    arrow_id = to_arrow_type(benchmark.schema[item].dataType)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = list(matches(shared.value, batch.column(text)))
        if not found:
            return None
        rows, items, both = zip(*found, strict=True)
        sizes = [len(shared.value.sets[i]) for i in items]
        columns = [batch.column(doc).take(pa.array(rows)), pa.array([shared.value.ids[i] for i in items], arrow_id), pa.array(sizes, pa.int64()), pa.array(both, pa.int64()), pa.array([b / s for b, s in zip(both, sizes, strict=True)])]
        return pa.RecordBatch.from_arrays(columns, names=[doc, item, "item_shingles", "shared_shingles", "containment"])

    return map_batches(docs.select(doc, text), run, kinds, text)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", limit: int = BLOCK_BYTES) -> DataFrame:
    """The documents that contain no item, all columns as they were."""
    index = index_of(benchmark, item, text, limit)
    if index is None:
        own, row = named_rows(docs, doc, text)
        gone = fresh("leaky", own.columns)
        found = contained(own, benchmark, row, item, text).select(F.col("doc").alias(gone)).distinct()
        return own.join(found, F.col(f"`{row}`") == F.col(gone), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = np.ones(batch.num_rows, dtype=bool)
        keep[[r for r, _, _ in matches(shared.value, batch.column(text))]] = False
        return batch.filter(pa.array(keep))

    return map_batches(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), text)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark"))
