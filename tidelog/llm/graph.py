"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import looked_up, remove, written
from tidelog.llm.wordhash import tidy

#: Edges that a task contracts at a time before the first round.
CONTRACT = 1 << 18
#: From so many edges on, nodes of most edges are looked up apart; fewer fit a task.
MANY_EDGES = 10_000


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of each task's own components: every node to the least of its component there."""

    def forest(pairs: Iterator[tuple[int, int]]) -> pa.RecordBatch:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y] = up.setdefault(y, y)
                x = up[x]
            return x

        for a, b in pairs:
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
        found = [(x, root(x)) for x in list(up)]
        a, b = zip(*((x, r) for x, r in found if x != r), strict=True) if any(x != r for x, r in found) else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int]] = []
        for batch in batches:
            held += zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)
            if len(held) >= CONTRACT:
                yield forest(held)
                held = []
        if held:
            yield forest(held)

    return edges.mapInArrow(tidy(run), "a bigint, b bigint")


def _with_least(edges: DataFrame, many: bool) -> DataFrame:
    """The edges (a, b) with low, the least b of each a."""
    low = edges.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))
    return looked_up(edges, low, ["a"], ["low"], "n") if many else edges.join(low.drop("n"), "a")


def _told(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge to another; root is the least node of its component.

    Each round the edges are written to the shared folder, so its plan stays
    short; the number of rounds grows with the logarithm of the longest path.
    A node with very many edges is no hot key of a join.
    """
    now, path = written(contracted(edges.filter("a <> b")).distinct(), "edges")
    told = _told(now)
    while True:
        many = told[0] >= MANY_EDGES
        both = _with_least(now.union(now.select("b", "a")), many)
        large = both.filter("b > a").select(F.col("b").alias("a"), F.least("a", "low").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small = _with_least(down, many).select(F.col("b").alias("x"), "low", "a").selectExpr("stack(2, x, low, a, low) as (a, b)").filter("a <> b").distinct()
        after, new_path = written(small, "edges")
        before, told = told, _told(after)
        remove(now.sparkSession, path)
        now, path = after, new_path
        if before == told:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
