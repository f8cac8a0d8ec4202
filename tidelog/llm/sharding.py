"""Sharding by minimax contiguous partition, the law ``bytes``.

Rows of equal text are one group, and groups are kept in a fixed order, that
of the text's md5; a shard is a run of groups.  The largest shard is as small
as it can be: the least capacity is found by binary search, each capacity
being checked by filling shards greedily in order.  Of the partitions within
that capacity an even one is taken: each shard ends at the group's end nearest
to its equal share of what is left, as far as the rest still fits, and no shard
stays empty while there are groups for it.

The search never holds all groups.  It starts from sums of groups by the first
digits of their keys, bounds the places where cuts can fall, and takes only
those parts apart further, down to single groups.

Null texts are one group, after the others, of size 1 a row, with a null
text_crc32; an empty text is a text.  A group may hold any share of the rows
and still is one; its rows are numbered in parts by a salt.  Repeated rows
count each; null ids are carried along; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.common import shuffle_partitions, tables, written

SHARDS = 16
LAW = "bytes"
#: Digits of the key by which groups are first summed, and by which parts are taken apart: 16 ** DIGITS sums.
DIGITS = 3
KEY_DIGITS = 32
#: Parts in which a shard is numbered, at most; their counts are broadcast.
MAX_SALTS = 4096
NULL_KEY = "null"


@dataclass(frozen=True)
class Part:
    """The groups whose keys begin with prefix; single if it is one group with that whole key."""

    prefix: str
    size: int
    single: bool


def cuts(totals: list[int], capacity: int, shards: int) -> list[int] | None:
    """Greedy filling of parts given their running totals: the end of each shard, or None if they don't fit."""
    ends, filled, at = [], 0, 0
    for _ in range(shards):
        at = bisect_right(totals, filled + capacity, at)
        ends.append(at)
        filled = totals[at - 1] if at else 0
    return ends if at == len(totals) else None


def least_capacity(sizes: list[int], shards: int, low: int = 0) -> int:
    """The smallest capacity, ``low`` or above, that greedy filling finds room with."""
    totals = list(accumulate(sizes))
    total = totals[-1] if totals else 0
    low = max(low, -(-total // shards), 0)
    high = max(low, -(-total // shards) + max(sizes, default=0))
    while low < high:
        middle = (low + high) // 2
        if cuts(totals, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def even_cuts(sizes: list[int], capacity: int, shards: int) -> tuple[list[int], set[int]]:
    """The end of each shard but the last, near equal shares within a capacity, and the parts on which they turned.

    The ends are right if none of those parts could be taken apart.
    """
    sums = [0, *accumulate(sizes)]
    n, total, turned = len(sizes), sums[-1], set()
    latest = [n]  # latest[j]: the first place from which all that follows fits j shards
    for _ in range(shards - 1):
        at = bisect_left(sums, sums[latest[-1]] - capacity, 0, latest[-1] + 1)
        if at:
            turned.add(at - 1)
        latest.append(at)
    ends, at = [], 0
    for left in range(shards, 1, -1):
        most = bisect_right(sums, sums[at] + capacity, at) - 1
        share = sums[at] + (total - sums[at]) / left
        near = bisect_left(sums, share, at, n + 1)
        if near < n:
            turned.update((max(0, near - 1), near))
        if near > at and (near > n or share - sums[near - 1] <= sums[near] - share):
            near -= 1
        if most < n:
            turned.add(most)
        low = max(latest[left - 1], min(n, at + 1))
        high = max(at, min(most, max(at + 1, n - (left - 1))))
        at = min(n, max(low, min(high, near)))
        ends.append(at)
    return ends, turned


def partition(groups: DataFrame, shards: int, digits: int = DIGITS) -> list[str]:
    """The first key of each shard but the first.  groups: key, size, by distinct key.

    A shard without groups has a key above all others.
    """
    spark = groups.sparkSession

    def parts(prefixes: list[str] | None, depth: int) -> list[Part]:
        found = groups
        if prefixes is not None:
            wanted = spark.createDataFrame([(p,) for p in prefixes], "p string")
            found = groups.join(F.broadcast(wanted), F.substring("key", 1, len(prefixes[0])) == F.col("p"), "left_semi")
        head = F.when(F.col("key") == NULL_KEY, F.col("key")).otherwise(F.substring("key", 1, depth))
        sums = found.groupBy(head.alias("prefix")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("key").alias("key"))
        return [Part(r["key"] if r["n"] == 1 else r["prefix"], r["size"], r["n"] == 1) for r in sums.collect()]

    def taken_apart(known: list[Part], which: set[int]) -> list[Part]:
        """The parts with those taken apart by ``digits`` more digits of their keys."""
        finer = []
        for length in sorted({len(known[j].prefix) for j in which}):
            finer += parts([known[j].prefix for j in sorted(which) if len(known[j].prefix) == length], min(KEY_DIGITS, length + digits))
        return sorted([p for j, p in enumerate(known) if j not in which] + finer, key=lambda p: p.prefix)

    largest = groups.agg(F.max("size")).first()[0] or 0
    known = sorted(parts(None, digits), key=lambda p: p.prefix)
    while True:
        sizes = [p.size for p in known]
        totals = list(accumulate(sizes))
        total = totals[-1] if totals else 0
        low = max(largest, -(-total // shards))
        high = least_capacity(sizes, shards, low)  # of whole parts, so enough for groups too
        if all(p.single for p in known) or low == high:
            break
        # A cut of groups lies no earlier than that of whole parts at the least capacity, and no later than full shards.
        filled, suspects, at = 0, set(), 0
        for k in range(1, shards):
            at = bisect_right(totals, filled + low, at)
            filled = totals[at - 1] if at else 0
            last = bisect_right(totals, min(total, k * high))
            suspects.update(j for j in range(at, min(last, len(known) - 1) + 1) if not known[j].single)
        if not suspects:
            break
        known = taken_apart(known, suspects)
    capacity = high
    while True:
        ends, turned = even_cuts([p.size for p in known], capacity, shards)
        if len(known) < 4 * shards:
            turned = set(range(len(known)))
        turned = {j for j in turned if not known[j].single}
        if not turned:
            break
        known = taken_apart(known, turned)
    return [known[e].prefix if e < len(known) else "~" for e in ends]


def shard_of(key: Column, firsts: list[str]) -> Column:
    return sum(((key >= F.lit(f)).cast("int") for f in firsts), F.lit(0))


def assign(docs: DataFrame, shards: int = SHARDS, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    The text is read once; what follows works on a narrow table of keys.
    """
    t = F.col(text)
    narrow, _ = written(
        docs.select(
            F.col(doc).alias("doc_id"),
            (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("bigint").alias("size"),
            F.crc32(t.cast("binary")).alias("text_crc32"),
            F.coalesce(F.md5(t.cast("binary")), F.lit(NULL_KEY)).alias("key"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-keys",
    )
    groups, _ = written(narrow.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    firsts = partition(groups, shards)
    salts = min(MAX_SALTS, 4 * shuffle_partitions(docs.sparkSession))
    placed = narrow.select("doc_id", "size", "text_crc32", "row", shard_of(F.col("key"), firsts).alias("shard"), F.pmod(F.xxhash64("row"), F.lit(salts)).alias("salt"))
    before = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "salt").count()
    firsts_of = counts.select("shard", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))  # shards x salts rows
    rank = F.row_number().over(Window.partitionBy("shard", "salt").orderBy("row"))
    return (
        placed.withColumn("rank", rank)
        .join(F.broadcast(firsts_of), ["shard", "salt"])
        .select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("first") + F.col("rank") - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(tables(spark, sf_dir, "documents"))
