"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to ``ORDER`` deep, with escape
probabilities (method C, with exclusion of what the longer context has seen).
The trees are frozen after fitting, so a text's code length under a language
is a sum of table entries; the least code length wins.  Languages are fitted
in blocks, those with samples of like size together, so that however many
there are, the trees of a block have the same room: no language is left out,
and each takes at most some 6 MB of the broadcast model.

Every language is learned from a bounded sample of its rows with text: at most
SAMPLE_ROWS of them and SAMPLE_BYTES together, each cut after SAMPLE_ROW_BYTES.

Texts that are null or have no letter get ``und`` and score 0; so does every
text if there is nothing to learn from.  Texts are scored whole, in pieces
that carry their context over, so long ones need no more memory.  Of languages
of equal code length the first by name wins.  Repeated rows are scored alike;
null ids and languages are never learned from; an empty table gives no rows;
other columns are kept, but for those named lang_pred and score, which give
way to the new ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm import wordhash as W
from tidelog.llm.common import fresh, map_batches, tables

ORDER = 3
#: The bounds of the fit: labelled rows a language, bytes a row, bytes a language, languages a block, and tables of a block.
SAMPLE_ROWS = 400
SAMPLE_ROW_BYTES = 32_768
SAMPLE_BYTES = 4 << 20
BLOCK = 4
TABLE_BYTES = 8 << 20
#: Up to this size the states of a block are looked up by context in one table, beyond it order by order; results are the same.
STATE_BYTES = 16 << 20

UNKNOWN = "und"
PIECE = 1 << 18


@dataclass
class Model:
    """classes: of each byte, 0 for those never learned.  kept: of each order the contexts in the tree, ascending.

    A context's state is its place among all kept, orders in turn.
    states: of each run of ORDER classes, oldest first, or None if that table would be too large.
    bits[l]: code length of class c after state s, at s * width + c, for language l.
    rest: the models of further blocks of languages.
    """

    languages: list[str]
    classes: np.ndarray
    width: int
    kept: list[np.ndarray]
    states: np.ndarray | None
    bits: np.ndarray
    rest: list[Model] = field(default_factory=list)

    def state(self, code: np.ndarray) -> np.ndarray:
        """The state of the longest kept context that each run of ORDER classes ends with."""
        if self.states is not None:
            return self.states[code].astype(np.int64)
        out, first = np.zeros(len(code), dtype=np.int64), 0
        for n, contexts in enumerate(self.kept):
            if n and len(contexts):
                short = code % self.width**n
                at = np.minimum(np.searchsorted(contexts, short), len(contexts) - 1)
                out = np.where(contexts[at] == short, first + at, out)
            first += len(contexts)
        return out


def _contexts(symbols: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """For each symbol the number of the ORDER symbols before it, 0 before a text's start."""
    code = np.zeros(len(symbols), dtype=np.int64)
    since = np.arange(len(symbols)) - np.repeat(starts, np.diff(np.append(starts, len(symbols))))
    for back in range(ORDER, 0, -1):
        before = np.zeros(len(symbols), dtype=np.int64)
        before[back:] = symbols[:-back] if back < len(symbols) else symbols[:0]
        before[since < back] = 0
        code = code * width + before
    return code


def _tree_tables(counts: list[dict[int, np.ndarray]], kept: list[np.ndarray], width: int, unseen: int) -> np.ndarray:
    """Probabilities of each class after each kept context of each order: one row a context, orders in turn.

    counts[k]: context of order k -> counts by class.  Each row sums to 1 over
    the 256 bytes, class 0 standing for ``unseen`` of them.
    """
    rows: list[np.ndarray] = []
    at: dict[tuple[int, int], int] = {}
    flat = np.full(width, 1 / 256)
    for order, contexts in enumerate(kept):
        for context in contexts.tolist():
            parent = rows[at[order - 1, context % width ** (order - 1)]] if order else flat
            own = counts[order].get(context)
            if own is None:
                row = parent
            else:
                seen = own > 0
                total, kinds = own.sum(), seen.sum()
                rest = parent.copy()
                rest[seen] = 0
                left = rest[1:].sum() + unseen * rest[0]
                if left <= 1e-12:
                    row = own / total
                else:
                    row = np.where(seen, own / (total + kinds), rest / left * (kinds / (total + kinds)))
            at[order, context] = len(rows)
            rows.append(row)
    return np.array(rows)


def fit(samples: dict[str, list[bytes]], order: int = ORDER, table_bytes: int = TABLE_BYTES) -> Model | None:
    """The frozen trees of some texts by language, with ``table_bytes`` for each block of languages; None if there are none."""
    languages = sorted((k for k, v in samples.items() if any(v)), key=lambda k: (-sum(map(len, samples[k])), k))
    if not languages:
        return None
    first, *rest = (_fit_block(sorted(languages[a : a + BLOCK]), samples, order, table_bytes) for a in range(0, len(languages), BLOCK))
    first.rest = rest
    return first


def _fit_block(languages: list[str], samples: dict[str, list[bytes]], order: int, table_bytes: int) -> Model:
    raws = {k: np.frombuffer(b"".join(samples[k]), dtype=np.uint8) for k in languages}
    seen = np.unique(np.concatenate([np.unique(r) for r in raws.values()]))
    classes = np.zeros(256, dtype=np.int64)
    classes[seen] = np.arange(1, len(seen) + 1)
    width = len(seen) + 1
    counts: list[list[dict[int, np.ndarray]]] = []
    total: list[dict[int, int]] = [{} for _ in range(order + 1)]
    for k in languages:
        lengths = np.array([len(t) for t in samples[k] if t])
        symbols = classes[raws[k]]
        code = _contexts(symbols, np.cumsum(lengths) - lengths, width)
        own: list[dict[int, np.ndarray]] = []
        for n in range(order + 1):
            contexts, which, often = np.unique(code % width**n, return_inverse=True, return_counts=True)
            table = np.bincount(which * width + symbols, minlength=len(contexts) * width).reshape(-1, width)
            own.append(dict(zip(contexts.tolist(), table.astype(float), strict=True)))
            for c, m in zip(contexts.tolist(), often.tolist(), strict=True):
                total[n][c] = total[n].get(c, 0) + m
        counts.append(own)
    room = max(width + 2, table_bytes // (4 * width * len(languages)))
    every = sorted(((-m, n, c) for n in range(1, order + 1) for c, m in total[n].items()), key=lambda x: (x[0], x[1], x[2]))
    chosen = {(n, c) for _, n, c in every[:room]}
    kept = [np.zeros(1, dtype=np.int64)]
    for n in range(1, order + 1):
        last = set(kept[-1].tolist())
        kept.append(np.array(sorted(c for k, c in chosen if k == n and c % width ** (n - 1) in last), dtype=np.int64))
    tables = [_tree_tables(own, kept, width, 256 - len(seen)) for own in counts]
    bits = np.stack([-np.log2(np.maximum(t, 1e-30)).astype(np.float32).ravel() for t in tables])
    kind = np.dtype(np.uint16 if bits.shape[1] // width <= 1 << 16 else np.int32)
    if width**order * kind.itemsize > STATE_BYTES:
        return Model(languages, classes, width, kept, None, bits)
    states, first = np.zeros(width**order, dtype=kind), 1
    for n in range(1, order + 1):
        wide = states.reshape(width ** (order - n), width**n)
        wide[:, kept[n]] = np.arange(first, first + len(kept[n]))
        first += len(kept[n])
    return Model(languages, classes, width, kept, states, bits)


def code_lengths(model: Model, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each row's whole text under each language."""
    rows = len(offsets) - 1
    out = np.zeros((len(model.languages), rows))
    width = model.width
    for a in range(0, len(raw), PIECE):
        b = min(a + PIECE, len(raw))
        back = max(0, a - ORDER)
        symbols = model.classes[raw[back:b]]
        code = np.zeros(b - a, dtype=np.int64)
        first = int(np.searchsorted(offsets, a, side="right")) - 1
        last = int(np.searchsorted(offsets, b, side="left"))
        edges = offsets[first:last]
        for k in range(ORDER, 0, -1):
            before = np.zeros(b - a, dtype=np.int64)
            lead = max(0, k - (a - back))
            before[lead:] = symbols[a - back + lead - k : len(symbols) - k]
            for d in range(k):  # no symbol of the text before
                at = edges + d - a
                before[at[(at >= 0) & (at < b - a)]] = 0
            code = code * width + before
        place = model.state(code) * width + symbols[a - back :]
        filled = np.flatnonzero(np.minimum(offsets[first + 1 : last + 1], b) > np.maximum(edges, a))
        at = np.maximum(edges[filled], a) - a
        for l in range(len(model.languages)):
            out[l, first + filled] += np.add.reduceat(model.bits[l][place], at, dtype=np.float64)
    return out


def predict(model: Model | None, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """The language of least code length and its posterior, all languages alike before; ties go to the first by name."""
    if model is None:
        return [UNKNOWN] * len(column), np.zeros(len(column))
    blocks = [model, *model.rest]
    named = [k for m in blocks for k in m.languages]
    by_name = sorted(range(len(named)), key=named.__getitem__)
    raw, offsets = W.utf8_buffer(column)
    bits = np.concatenate([code_lengths(m, raw, offsets) for m in blocks])[by_name]
    best = bits.argmin(axis=0)
    odds = np.exp2(np.maximum(bits.min(axis=0) - bits, -1000))
    return [named[by_name[k]] for k in best.tolist()], 1 / odds.sum(axis=0)


def fit_on(docs: DataFrame, text: str, language: str, order: Column, rows: int = SAMPLE_ROWS, row_bytes: int = SAMPLE_ROW_BYTES, nbytes: int = SAMPLE_BYTES) -> Model | None:
    """A model of a sample of the labelled rows with text: of each language at most ``rows``, cut after ``row_bytes`` bytes, and ``nbytes`` in all.

    ``order``: a hash of each row, by which the sample is chosen.  Only some
    twice the rows asked for are ranked, the head of the order.
    """
    share = F.pmod(order, F.lit(1 << 30)) / (1 << 30)
    pool = docs.filter(F.col(language).isNotNull() & order.isNotNull() & (F.col(text) != ""))
    found = pool.groupBy(F.col(language).alias("l")).count().collect()
    if not found:
        return None
    bound = F.create_map(*(F.lit(x) for r in found for x in (r["l"], 2.0 * rows / r["count"] + 1e-9)))[F.col(language)]
    near = pool.filter(share < bound).select(F.col(language).alias("l"), F.left(F.col(text), F.lit(row_bytes)).alias("t"), share.alias("s"))
    first = Window.partitionBy("l").orderBy("s", "t")
    ranked = near.withColumns({"k": F.row_number().over(first), "before": F.sum(F.least(F.octet_length("t"), F.lit(row_bytes))).over(first.rowsBetween(Window.unboundedPreceding, -1))})
    head = ranked.filter((F.col("k") <= rows) & (F.coalesce("before", F.lit(0)) < nbytes)).select("l", "t", "s").collect()
    samples: dict[str, list[bytes]] = {}
    for r in sorted(head, key=lambda r: (r["s"], r["t"])):
        samples.setdefault(r["l"], []).append(r["t"].encode()[:row_bytes])
    return fit(samples)


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The frame with lang_pred and score in place of the text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rest = [f for f in docs.schema.fields if f.name not in (text, "lang_pred", "score")]
    mark = fresh("lettered", docs.columns)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        languages, scores = predict(shared.value, batch.column(text))
        lettered = batch.column(mark).to_pylist()
        languages = [k if ok else UNKNOWN for k, ok in zip(languages, lettered, strict=True)]
        scores = np.where(np.array(lettered, dtype=bool), scores, 0.0)
        columns = [batch.column(f.name) for f in rest] + [pa.array(languages, pa.string()), pa.array(scores)]
        return pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in rest), "lang_pred", "score"])

    lettered = docs.withColumn(mark, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + ["lang_pred string, score double"])
    return map_batches(lettered, run, kinds, text)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    held_out = F.coalesce(crc % 4 == 2, F.lit(False))
    model = fit_on(docs.filter(crc % 4 != 2), "text", "lang", F.xxhash64("doc_id", F.lit("sample")))
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), model)
