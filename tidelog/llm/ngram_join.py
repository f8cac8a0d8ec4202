"""N-gram Jaccard join: which texts share enough of their five-word shingles, exactly.

Texts are sets of shingle hashes; equal sets are one set from the start.

1. Low tokens.  Of each set go on the tokens in a fixed low share of the hash
   range, where it is known how many sets hold each.  A token that no other set
   holds counts against its set: more of those than a similar set may lack, and
   the set is alone.  Tokens travel by parts of the hash range, more parts than
   partitions; nothing but a token and its set's key does.
2. Groups.  Tokens are ordered rare first, those out of the range last and by
   hash.  In this order similar sets share one of their first few, the prefix.
   Sets are connected where a prefix token and a size class join them, so
   similar sets are always in one group, and what many sets share joins few.
3. Join.  Within a group, sets are joined by set-relation skipping
   (``skip_join``).  Of a group too large for a task a few sets are compared
   with all others first, which gathers nearly all of a group of copies.  The
   sets outside its largest component are then joined with those that share a
   prefix token, token by token, and a token of too many sets block by block:
   each such cell is joined in a task by the same skipping, sets known to be of
   one component not being compared.

Null and empty texts have no shingles and are linked with nothing, not with
one another.  Fewer than five words are one shingle.  Repeated rows are equal
sets.  Null ids take part; the smallest id is that of those not null, and null
if there is none.  An empty table gives no rows; other columns are ignored.

Shingles are known by hashes of 64 bits, equal sets by keys of 128: a key that
is dealt by and a check beside it.  Sets of one key and different checks stay
apart and have all of each other's tokens looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import wordhash as W
from tidelog.llm.common import broadcast_if_small, fresh, looked_up, named_rows, shuffle_partitions, tables, written
from tidelog.llm.graph import components
from tidelog.llm.skip_join import Group, Index, linked

PERCENT = 80
#: The share of the hash range in which tokens of all sets are looked at.
RANGE = 0.3
#: Bytes that a broadcast may take in memory, and that a row of ids takes there.
BROADCAST_BYTES = 16 << 20
ROW_BYTES = 64
#: Tokens of a group that one task joins, and of a block of a group too large for one; pivots have as many at most.
GROUP_TOKENS = 4_000_000
BLOCK_TOKENS = 1_000_000
PIVOTS = 32
#: Low tokens that a task holds before it passes blocks on.
BLOCK_OF_TOKENS = 300_000
MOST_TOKENS = 4_000_000
#: Keys of sets that a task remembers, so as not to pass a set on twice.
SEEN = 1_000_000
PIVOT_ROUNDS = 4

#: Stands for how many sets hold a token that was not counted.
OUT_OF_RANGE = (1 << 31) - 1

DDL = "doc {}, n_shingles bigint, skey bigint, scheck bigint, kind int, part int, sets int, data binary"
NAMES = ["doc", "n_shingles", "skey", "scheck", "kind", "part", "sets", "data"]
#: Kinds of blocks: of sets, of tokens (shared ones, if in range or out of it).
HEADS, TOKENS, IN_RANGE, OUTSIDE = range(4)
#: Tokens of a set that one entry of a block holds.
ENTRY = 255


def prefix_length(n, percent: int = PERCENT):
    return n - (-(-percent * n // 100)) + 1


def set_keys(s: np.ndarray) -> tuple[int, int]:
    """A key of the whole set and a check beside it, 64 bits each; both 0 if empty."""
    if not len(s):
        return 0, 0
    out = []
    for salt in (1, 0x5851F42D4C957F2D):
        total = W.mix(s * np.uint64(0x9FB21C651E98DF25) + np.uint64(salt)).sum(dtype=np.uint64) + np.uint64(len(s))
        out.append(int(W.mix(np.array([total]))[0].astype(np.int64)) or 1)
    return out[0], out[1]


def part_bits(spark: SparkSession) -> int:
    """Token parts are 2 ** bits: of those in range, which hold most tokens, two a shuffle partition at least."""
    return max(6, int(2 * shuffle_partitions(spark) / RANGE).bit_length())


def key_parts(spark: SparkSession) -> int:
    return 2 * shuffle_partitions(spark)


def _enough(parts: int) -> int:
    """Tokens that a task holds before it passes them on by part, so that blocks don't get small where parts are many."""
    return min(MOST_TOKENS, max(BLOCK_OF_TOKENS, 4 * parts))


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin in sorted columns."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def signatures(docs: DataFrame, bits: int, parts: int, percent: int = PERCENT) -> DataFrame:
    """A row a document (doc, n_shingles, skey, scheck); blocks of sets by part of their keys: keys, checks, sizes, tokens in range; and of low tokens by part: keys, how many tokens each has, the tokens."""
    top = int(RANGE * (1 << bits)) << (64 - bits)
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(docs.schema["doc"].dataType), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    schema = pa.schema(list(zip(NAMES, kinds, strict=True)))

    def batch(kind: int, part: np.ndarray, sets: np.ndarray, data: list[bytes]) -> pa.RecordBatch:
        n = len(part)
        return pa.RecordBatch.from_arrays([*(pa.nulls(n, k) for k in kinds[:4]), pa.array([kind] * n, pa.int32()), pa.array(part, pa.int32()), pa.array(sets, pa.int32()), pa.array(data, pa.binary())], schema=schema)

    def blocks(held: list[tuple[int, int, int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        head = np.array([h[:4] for h in held], dtype=np.int64)
        where = (head[:, 0].astype(np.uint64) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        head, where = head[order], where[order]
        at = _runs(where)
        ends = np.append(at[1:], len(where))
        yield batch(HEADS, where[at], ends - at, [head[i:j, :2].T.astype("<i8").tobytes() + head[i:j, 2:].T.astype("<u4").tobytes() for i, j in zip(at.tolist(), ends.tolist(), strict=True)])
        tokens = np.concatenate([t for *_, t in held])
        owner = np.repeat(np.arange(len(held)), [len(t) for *_, t in held])
        part = (tokens >> np.uint64(64 - bits)).astype(np.int64)
        order = np.lexsort((owner, part))
        part, owner, tokens = part[order], owner[order], tokens[order]
        at = _runs(part, owner)
        inner = np.arange(len(part)) - np.repeat(at, np.diff(np.append(at, len(part))))
        at = np.flatnonzero(inner % ENTRY == 0)
        here = np.diff(np.append(at, len(part)))
        keys = np.array([h[0] for h in held], dtype="<i8")[owner[at]]
        low = (tokens >> np.uint64(32 - bits)).astype("<u4")
        starts = _runs(part[at])
        ends = np.append(starts[1:], len(at))
        token_at = np.append(at, len(part))
        data = [keys[i:j].tobytes() + here[i:j].astype("<u1").tobytes() + low[token_at[i] : token_at[j]].tobytes() for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
        yield batch(TOKENS, part[at][starts], ends - starts, data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, seen = [], 0, set()
        for given in batches:
            for chunk in W.text_chunks(given, "text"):
                sizes, keys, checks = [], [], []
                for s in W.shingle_sets(chunk.column("text")):
                    key, check = set_keys(s)
                    sizes.append(len(s))
                    keys.append(key)
                    checks.append(check)
                    if len(s) and (key, check) not in seen:
                        seen.add((key, check))
                        ranged = int(np.searchsorted(s, np.uint64(top)))
                        held.append((key, check, len(s), ranged, s[: max(ranged, prefix_length(len(s), percent))].copy()))
                        n += len(held[-1][4])
                        if n >= _enough(1 << bits):
                            yield from blocks(held)
                            held, n = [], 0
                rows = chunk.num_rows
                yield pa.RecordBatch.from_arrays([chunk.column("doc"), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(checks, pa.int64()), *(pa.nulls(rows, k) for k in kinds[4:])], schema=schema)
                if len(seen) > SEEN:
                    seen.clear()
        if held:
            yield from blocks(held)

    return docs.select("doc", "text").mapInArrow(W.tidy(run), DDL.format(docs.schema["doc"].dataType.simpleString()))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """The blocks (kind, sets, data) of each part together, from rows sorted by part."""
    now, held = None, []
    for batch in batches:
        for part, kind, n, data in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "sets", "data")), strict=True):
            if part != now and held:
                yield now, held
                held = []
            now = part
            held.append((kind, n, data))
    if held:
        yield now, held


def _by_part(blocks: DataFrame) -> DataFrame:
    return blocks.repartition(shuffle_partitions(blocks.sparkSession), "part").sortWithinPartitions("part")


BLOCKS = "kind int, part int, sets int, data binary"


def shared_tokens(blocks: DataFrame, bits: int, parts: int, percent: int = PERCENT) -> DataFrame:
    """Blocks by part of the set keys, of the tokens that several sets hold: keys, how many each has, the tokens and in how many sets each is.

    Out of the range tokens are said to be in more sets than any other, so
    they come last and in order of hash.  A part is held at a time, and what
    is passed on is put together over parts.
    """
    top = int(RANGE * (1 << bits))

    def one(part: int, datas: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key, token and in how many sets it is, of each token of a set that others hold, too."""
        here = [np.frombuffer(data, "<u1", n, 8 * n) for _, n, data in datas]
        key = np.concatenate([np.repeat(np.frombuffer(data, "<i8", n), h) for (_, n, data), h in zip(datas, here, strict=True)])
        token = np.concatenate([np.frombuffer(data, "<u4", offset=9 * n) for _, n, data in datas])
        order = np.lexsort((key, token))
        key, token = key[order], token[order]
        at = _runs(token, key)  # a set may come from several tasks
        key, token = key[at], token[at]
        often = np.diff(np.append(_runs(token), len(token)))
        several = np.repeat(often > 1, often)
        names = (np.int64(part) << np.int64(32)) | token[several].astype(np.int64)
        times = np.minimum(np.repeat(often, often)[several], OUT_OF_RANGE - 1) if part < top else np.full(len(names), OUT_OF_RANGE)
        return key[several], names, times

    def by_key(kind: int, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        key, names, times = (np.concatenate(c) for c in zip(*held, strict=True))
        to = (key.astype(np.uint64) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((key, to))
        key, names, times, to = key[order], names[order], times[order], to[order]
        sets = _runs(to, key)
        bounds = np.append(sets, len(key))
        count = np.diff(bounds)
        at = _runs(to[sets])
        ends = np.append(at[1:], len(sets))
        data = []
        for i, j in zip(at.tolist(), ends.tolist(), strict=True):
            x, y = bounds[i], bounds[j]
            data.append(key[sets[i:j]].astype("<i8").tobytes() + count[i:j].astype("<u4").tobytes() + names[x:y].astype("<i8").tobytes() + times[x:y].astype("<u4").tobytes())
        n = len(at)
        return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array(to[sets[at]], pa.int32()), pa.array(ends - at, pa.int32()), pa.array(data, pa.binary())], names=["kind", "part", "sets", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {IN_RANGE: [], OUTSIDE: []}
        size = {IN_RANGE: 0, OUTSIDE: 0}
        for part, datas in _grouped(batches):
            found = one(part, datas)
            kind = IN_RANGE if part < top else OUTSIDE
            if len(found[0]):
                held[kind].append(found)
                size[kind] += len(found[0])
            if size[kind] >= _enough(parts):
                yield by_key(kind, held[kind])
                held[kind], size[kind] = [], 0
        for kind, rest in held.items():
            if rest:
                yield by_key(kind, rest)

    return _by_part(blocks).mapInArrow(W.tidy(run), BLOCKS)


def prefixes(blocks: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(skey, scheck, n, tokens) of each set that may have a similar one: the tokens of its prefix that other sets hold.

    blocks: of sets and of shared tokens.  Of a prefix the tokens that no other set holds come first.
    """
    names = ["skey", "scheck", "n", "tokens"]

    def one(datas: list[tuple[int, int, bytes]]) -> pa.RecordBatch | None:
        heads, keys, tokens, times, counts = [], [], [], [], []
        for kind, n, data in datas:
            own = np.frombuffer(data, "<i8", n)
            if kind == HEADS:
                heads.append(np.column_stack([own, np.frombuffer(data, "<i8", n, 8 * n), np.frombuffer(data, "<u4", 2 * n, 16 * n).reshape(2, n).T]))
                continue
            count = np.frombuffer(data, "<u4", n, 8 * n).astype(np.int64)
            m = int(count.sum())
            keys.append(np.repeat(own, count))
            tokens.append(np.frombuffer(data, "<i8", m, 12 * n))
            times.append(np.frombuffer(data, "<u4", m, 12 * n + 8 * m))
            counts.append(np.full(m, kind == IN_RANGE))
        if not tokens:
            return None
        head = np.concatenate(heads)
        head = head[np.lexsort((head[:, 1], head[:, 0]))]
        head = head[_runs(head[:, 0], head[:, 1])]
        first = _runs(head[:, 0])
        skey, checks = head[first, 0], np.diff(np.append(first, len(head)))
        owner = np.searchsorted(skey, np.concatenate(keys))
        token, time = np.concatenate(tokens), np.concatenate(times)
        n, ranged = head[first, 2], head[first, 3]
        alone = ranged - np.bincount(owner[np.concatenate(counts)], minlength=len(skey))
        most = np.where(100 * alone <= (100 - percent) * n, prefix_length(n, percent) - alone, 0)
        most[checks > 1] = len(token)  # sets of one key and different checks
        order = np.lexsort((token, time, owner))
        owner, token = owner[order], token[order]
        held = np.bincount(owner, minlength=len(skey))
        place = np.arange(len(owner)) - np.repeat(np.cumsum(held) - held, held)
        keep = place < most[owner]
        left = np.bincount(owner[keep], minlength=len(skey))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(left)]).astype(np.int32)), pa.array(token[keep], pa.int64()))
        of = np.repeat(np.arange(len(skey)), checks)
        near = np.flatnonzero(left[of])
        return pa.RecordBatch.from_arrays([*(pa.array(head[near, k], pa.int64()) for k in range(3)), lists.take(pa.array(of[near]))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, datas in _grouped(batches):
            if (out := one(datas)) is not None:
                yield out

    return _by_part(blocks).mapInArrow(W.tidy(run), "skey bigint, scheck bigint, n bigint, tokens array<bigint>")


def size_class(n: Column, percent: int = PERCENT) -> Column:
    """Classes of sizes, each up to the ratio that similar sets may have; similar sets are in one or in two neighbours."""
    return F.floor(F.log(n) / float(np.log(100 / percent)) + 1e-9).cast("int")


def group_edges(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Edges (a, b) that connect sets (id, n, tokens) which share a prefix token and are of like size.

    A set goes to the least set of its token and size class, and that to the
    least of the next class; sizes of similar sets differ by one class at most.
    """
    rows = sets.select("id", size_class(F.col("n"), percent).alias("class"), F.explode("tokens").alias("token"))
    heads = rows.groupBy("token", "class").agg(F.min("id").alias("head"), F.count("*").alias("sets"))
    inner = looked_up(rows, heads.filter("sets > 1"), ["token", "class"], ["head"], "sets").filter("head is not null").select(F.col("id").alias("a"), F.col("head").alias("b"))
    upper = heads.select("token", (F.col("class") - 1).alias("class"), F.col("head").alias("b"))
    across = heads.select("token", "class", F.col("head").alias("a")).join(upper, ["token", "class"]).select("a", "b")
    return inner.union(across).filter("a <> b").distinct()


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(label, skey, tokens) from the texts of the documents named in wanted (doc, label); skey is the document."""
    texts = docs.select("doc", "text").join(broadcast_if_small(wanted, ROW_BYTES * wanted.count(), BROADCAST_BYTES), "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in W.text_chunks(batch, "text"):
                tokens = [s.tobytes() for s in W.shingle_sets(chunk.column("text"))]
                yield pa.RecordBatch.from_arrays([chunk.column("label"), chunk.column("skey"), pa.array(tokens, pa.binary())], names=["label", "skey", "tokens"])

    return texts.select("text", "label", F.col("doc").cast("bigint").alias("skey")).mapInArrow(W.tidy(run), "label bigint, skey bigint, tokens binary")


def join_groups(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(skey, root) of each set, its group's sets (label, skey, tokens) being joined in one task; root is a set of its component.

    A column known, if there is one, names the component that a set is known to be of.
    """
    columns = ["skey", "tokens", *(["known"] if "known" in sets.columns else [])]

    def one(rows: list[tuple]) -> pa.RecordBatch:
        keys, tokens, *known = zip(*rows, strict=True)
        roots = Group([np.frombuffer(t, np.uint64) for t in tokens], percent, *known).labels()
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([keys[r] for r in roots], pa.int64())], names=["skey", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for label, *row in zip(*(batch.column(c).to_pylist() for c in ["label", *columns]), strict=True):
                if label != now and held:
                    yield one(held)
                    held = []
                now = label
                held.append(row)
        if held:
            yield one(held)

    parted = sets.select("label", *columns).repartition(shuffle_partitions(sets.sparkSession), "label").sortWithinPartitions("label")
    return parted.mapInArrow(W.tidy(run), "skey bigint, root bigint")


def links_with(sets: DataFrame, block: list[tuple[int, bytes, int]], percent: int = PERCENT) -> DataFrame:
    """Links (a, b) of all sets with those of a block of (skey, tokens, component): one for each component there."""
    spark = sets.sparkSession
    shared = spark.sparkContext.broadcast((np.array([k for k, _, _ in block]), np.array([c for _, _, c in block]), [np.frombuffer(t, np.uint64) for _, t, _ in block]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, component, tokens = shared.value
        index = Index(tokens)
        for batch in batches:
            a, b = [], []
            for key, raw in zip(batch.column("skey").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                own = np.frombuffer(raw, np.uint64)
                hit = np.flatnonzero(linked(index.overlaps(own), len(own), index.sizes, percent) & (keys != key))
                _, one = np.unique(component[hit], return_index=True)
                a += [key] * len(one)
                b += keys[hit[one]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return sets.select("skey", "tokens").mapInArrow(W.tidy(run), "a bigint, b bigint")


def cells(members: DataFrame, near: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(label, skey, known): where sets of large groups meet that may be similar and are not known to be of one component.

    members: label, skey, n, root, rest, the last telling the sets outside their group's largest component.
    A cell is a prefix token that one of those holds, of a block of all sets that hold it and a block of the rest's.
    """
    sets = near.select(F.col("id").alias("skey"), "tokens").join(members.select("skey", "n", "root", "rest"), "skey")
    rows = sets.select("skey", "n", "root", "rest", F.explode("tokens").alias("token"))
    n = F.col("n")
    told = rows.groupBy("token").agg(F.sum(n).alias("all_tokens"), F.sum(F.when(F.col("rest"), n)).alias("rest_tokens"), F.count("*").alias("sets"))
    blocks = lambda c: F.ceil(F.col(c) / block_tokens).cast("int")
    told = told.filter("rest_tokens > 0 and sets > 1").select("token", "sets", blocks("all_tokens").alias("wide"), blocks("rest_tokens").alias("high"))
    told, _ = written(told, "prefix-tokens")
    held = looked_up(rows, told, ["token"], ["wide", "high"], "sets").filter("wide is not null")
    column, row = F.pmod(F.xxhash64("skey"), F.col("wide")), F.pmod(F.xxhash64("skey", F.lit(1)), F.col("high"))
    every = held.select("*", column.alias("c"), F.explode(F.sequence(F.lit(0), F.col("high") - 1)).alias("r"))
    some = held.filter("rest").select("*", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("c"), row.alias("r"))
    return every.unionByName(some).select(F.xxhash64("token", F.col("c").cast("int"), F.col("r").cast("int")).alias("label"), "skey", F.col("root").alias("known")).distinct()


def join_large(sets: DataFrame, near: DataFrame, percent: int = PERCENT, pivots: int = PIVOTS, rounds: int = PIVOT_ROUNDS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(skey, root) of each set of groups too large for a task.

    Every pair across the components found has an end outside its group's
    largest component, and each such set was compared with all that share a
    prefix token with it.
    """
    sets, _ = written(sets.select("label", "skey", "tokens"), "large-groups")
    every, _ = written(sets.select("label", "skey", (F.length("tokens") / 8).cast("bigint").alias("n")), "large-members")
    labels = every.withColumn("root", F.col("skey"))
    links = None

    def told_apart(labels: DataFrame) -> DataFrame:
        sizes = labels.groupBy("label", "root").count()
        largest = sizes.groupBy("label").agg(F.max(F.struct("count", "root")).alias("top")).select("label", F.col("top.root").alias("top"))
        return labels.join(largest, "label").withColumn("rest", F.col("root") != F.col("top")).drop("top")

    def relabelled(links: DataFrame) -> DataFrame:
        roots = components(links)
        found = every.join(roots, every.skey == roots.node, "left").select("label", "skey", "n", F.coalesce("root", "skey").alias("root"))
        return written(found, "large-labels")[0]

    for turn in range(rounds):
        pool = told_apart(labels).filter("rest") if links is not None else labels
        chosen = pool.filter(F.col("n") <= block_tokens // pivots).orderBy(F.xxhash64("skey", F.lit(turn))).limit(pivots)
        rows = sets.join(F.broadcast(chosen.select("skey", "root")), "skey").collect()  # pivots of them, block_tokens in all
        if not rows:
            break
        new = links_with(sets, [(r["skey"], bytes(r["tokens"]), r["root"]) for r in rows], percent)
        links = written(new if links is None else links.union(new), "large-links")[0]
        labels = relabelled(links)
    members, _ = written(told_apart(labels), "large-members")
    met = cells(members, near, block_tokens).join(sets.select("skey", "tokens"), "skey")
    found = join_groups(met, percent).select(F.col("skey").alias("a"), F.col("root").alias("b"))
    every_link, _ = written(found.union(members.select(F.col("skey").alias("a"), F.col("root").alias("b"))).filter("a <> b").distinct(), "large-links")
    return relabelled(every_link).select("skey", "root")


def _larger_than(sets: DataFrame, tokens: int) -> DataFrame:
    """The labels of groups with more tokens than that; a row for each such group."""
    sizes = sets.groupBy("label").agg(F.sum(F.length("tokens") / 8).alias("tokens"))
    return written(sizes.filter(F.col("tokens") > tokens).select("label"), "large-group-labels")[0]


def join_all(sets: DataFrame, near: DataFrame, percent: int = PERCENT, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """(skey, root) of each set of the groups (label, skey, tokens), whatever their sizes."""
    large = _larger_than(sets, group_tokens)
    if large.isEmpty():
        return join_groups(sets, percent)
    roots = join_groups(sets.join(large, "label", "left_anti"), percent)
    return roots.union(join_large(sets.join(large, "label", "left_semi"), near, percent))


def similar(docs: DataFrame, percent: int = PERCENT, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """doc, n_shingles and component, the smallest doc of the component, for a frame of doc and text.

    doc must be a whole number, never null nor repeated; see :func:`named_rows`.
    """
    spark = docs.sparkSession
    bits, parts = part_bits(spark), key_parts(spark)
    signed, _ = written(signatures(docs, bits, parts, percent), "signatures")
    known = signed.filter("skey is not null").select("doc", "n_shingles", "skey", "scheck")
    blocks = signed.filter("part is not null").select("kind", "part", "sets", "data")
    shared = shared_tokens(blocks.filter(F.col("kind") == TOKENS), bits, parts, percent)
    near, _ = written(prefixes(blocks.filter(F.col("kind") == HEADS).unionByName(shared), percent), "prefixes")
    reps = known.filter("n_shingles > 0").groupBy("skey", "scheck").agg(F.min("doc").cast("bigint").alias("rep"), F.count("*").alias("copies"))
    reps, _ = written(reps, "representatives")
    near = near.join(reps, ["skey", "scheck"]).select(F.col("rep").alias("id"), "n", "tokens")
    near, _ = written(near, "near-sets")
    wanted, _ = written(components(group_edges(near, percent)).select(F.col("node").alias("doc"), F.col("root").alias("label")), "group-members")
    sets, _ = written(sets_of(docs, wanted), "group-sets")
    roots, _ = written(join_all(sets, near, percent, group_tokens), "roots")
    least = roots.groupBy("root").agg(F.min("skey").alias("component"), F.count("*").alias("sets"))
    named = looked_up(roots, least, ["root"], ["component"], "sets").select(F.col("skey").alias("rep"), "component")
    names, _ = written(reps.join(named, "rep", "left").select("skey", "scheck", "copies", F.coalesce("component", "rep").alias("component")), "components")
    out = looked_up(known, names, ["skey", "scheck"], ["component"], "copies")
    return out.select("doc", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc")).alias("component"))


def jaccard_components(docs: DataFrame, doc: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The id, n_shingles and component_id, the smallest id that links reach, of every row."""
    own, row = named_rows(docs, doc, text)
    found = similar(own.select(F.col(row).alias("doc"), F.col(text).alias("text")), percent)
    if row == doc:
        return found.withColumnsRenamed({"doc": doc, "component": "component_id"})
    found = found.join(own.select(F.col(row).alias("doc"), doc), "doc")
    least = found.groupBy("component").agg(F.min(doc).alias("component_id"))
    return found.join(least, "component").select(doc, "n_shingles", "component_id")


def one_of_each(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay if of each component only the first row by id does; all columns as they were."""
    own, row = named_rows(docs, doc, text)
    found = similar(own.select(F.col(row).alias("doc"), F.col(text).alias("text")))
    copy = fresh("copy", own.columns)
    gone, _ = written(found.filter("doc <> component").select(F.col("doc").alias(copy)), "copies")
    rest = own.join(broadcast_if_small(gone, ROW_BYTES * gone.count(), BROADCAST_BYTES), F.col(f"`{row}`") == F.col(copy), "left_anti")
    return rest.select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(tables(spark, sf_dir, "documents"))
