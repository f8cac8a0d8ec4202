"""Removal of repeated 100-byte strings by the phrases of a prefix-free parsing.

A byte goes if a ``LENGTH``-byte string of its document that covers it also
starts earlier: in a document of a smaller id, or earlier in its own.

Parsing.  A rolling hash runs over every ``GRAM`` bytes; each window of LENGTH
bytes is triggered by the least hash within it.  Windows in a row with one
trigger make a phrase, and neighbouring phrases overlap by LENGTH - 1 bytes,
so every window lies in exactly one phrase and equal windows lie in phrases of
equal trigger, whatever surrounds them.

Dictionary.  Phrases are gathered by trigger.  Of equal phrases only the first
in corpus order stays in the dictionary; the windows of all others start
earlier elsewhere.  A trigger with one phrase in the dictionary is done, which
is most of any text that is not repeated.

Suffix array.  The remaining phrases go as strings to the part of their
trigger, in corpus order, and there the suffixes of that part of the
dictionary are ranked by content, by prefix doubling, to a depth of exactly
LENGTH bytes.  Suffixes of one rank are equal windows.

Parse and corpus order.  The parse, a document's phrases in a row, is kept as
each dictionary phrase's first place.  Where phrases meet in a trigger only, a
suffix goes on into the phrases after its own, and the parse needs a suffix
array to rank those; phrases that overlap by LENGTH - 1 bytes hold every window
whole, so that array would decide nothing and is not built.  Combined with the
places, all but the first of each rank start earlier elsewhere.

Each step first combines within its task, so a passage that a third of the
corpus shares sends a row a task and not a row an occurrence.  A trigger with
very many phrases is split over tasks by window: its windows go as strings of
their own, dealt by their content, to so many parts that none of them has more
bytes to rank than a trigger may have that is not split; and there are more
parts the more there is to rank.  What is gathered in one row, phrases and
spans, is of one document, whose text is in the row as well.

Windows are compared byte by byte.  That two phrases of one trigger are equal
is told by fingerprints modulo a prime, to two bases, of 62 bits together.
Null texts count as empty; texts shorter than LENGTH bytes keep all they have.  Ids that
are null or occur twice are told apart by rows: null ids come first, rows of
one id follow in the order in which they are numbered.  An empty table gives
no rows; other columns are ignored.  A long text is hashed piece by piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import wordhash as W
from tidelog.llm.common import broadcast_if_small, shuffle_partitions, tables, written

LENGTH = 100
GRAM = 32
#: Bytes hashed at a time.
PIECE = 1 << 18
#: Phrases or windows that a task combines at a time before it passes them on.
COMBINE = 1 << 18
#: Phrases of one trigger that one task compares; of a trigger with more the windows are dealt out.
SPLIT = 20_000
#: Bytes of strings that a part has to rank, about.
RANKED = 1 << 20
#: Bytes that count as a phrase, as a text that repeats itself makes phrases of any length.
PHRASE_BYTES = 150
#: Phrases of a text taken out of it at a time.
STRINGS = 1 << 12
#: A table is broadcast if it takes at most so many bytes in memory.
BROADCAST_BYTES = 12 << 20
#: Set in a phrase's count of windows if it may hold two that are equal.
AGAIN = 1 << 31

_PRIME = np.uint64((1 << 31) - 1)
_BASES = (0x2545F491, 0x5851F42D)
_ROLL = 0x9E3779B97F4A7C15
_grown: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, n: int, prime: int = 0) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo prime or else 2 ** 64; grown by doubling and kept."""
    have = _grown.get((base, prime), np.ones(1, dtype=np.uint64))
    while len(have) < n:
        more = have * np.uint64(pow(base, len(have), prime or 1 << 64))
        have = np.concatenate([have, _reduced(more) if prime else more])
    _grown[base, prime] = have
    return have[:n]


def _folded(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, or some primes more."""
    return (x & _PRIME) + (x >> np.uint64(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    x = _folded(_folded(_folded(x)))
    return np.where(x >= _PRIME, x - _PRIME, x)


_byte_values = W.mix(np.arange(1, 257, dtype=np.uint64) * W._STEP)
_byte_residues = _byte_values % (_PRIME - np.uint64(1)) + np.uint64(1)


def _sums(raw: np.ndarray) -> np.ndarray:
    """Running sums of byte values times powers: a rolling hash of any substring in two look-ups."""
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_byte_values[raw] * _powers(_ROLL, len(raw)), out=total[1:])
    return total


def _substrings(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rolling hashes, modulo 2 ** 64: good to deal by and to choose triggers by, not to tell strings apart."""
    return W.mix((total[ends] - total[starts]) * _powers(pow(_ROLL, -1, 1 << 64), len(total))[starts])


def _fingerprints(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of substrings: polynomials modulo the prime to two bases, side by side.  raw: at most some 2 ** 32 bytes."""
    out, prime = np.zeros(len(starts), dtype=np.uint64), int(_PRIME)
    for base in _BASES:
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_folded(_byte_residues[raw] * _powers(base, len(raw), prime)), out=total[1:])
        own = _reduced(total[ends] - total[starts]) * _powers(pow(base, -1, prime), len(total), prime)[starts]
        out = (out << np.uint64(31)) | _reduced(own)
    return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    out, span = values, 1
    while span * 2 <= width:
        out, span = np.minimum(out[:-span], out[span:]), span * 2
    extra = width - span
    return np.minimum(out[: len(out) - extra], out[extra:]) if extra else out


def phrases(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(trigger, first window, windows, fingerprint) of each phrase of one text.

    A text of many pieces is cut into overlapping ones; a phrase that lies
    across a cut comes as two, which is as good.
    """
    out: list[tuple[np.ndarray, ...]] = []
    windows = len(raw) - length + 1
    for a in range(0, max(windows, 0), PIECE):
        piece = raw[a : a + PIECE + length - 1]
        total = _sums(piece)
        at = np.arange(len(piece) - gram + 1)
        out.append(_runs(_substrings(total, at, at + gram), piece, np.zeros(0, np.int64), length, gram, a))
    if not out:
        return (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _runs(grams: np.ndarray, raw: np.ndarray, edges: np.ndarray, length: int, gram: int, shift: int) -> tuple[np.ndarray, ...]:
    """Phrases of a text's gram hashes; no phrase goes over an edge.

    The count of a phrase whose trigger occurs in it more than once, as it
    must if two of its own windows are equal, has the bit ``AGAIN`` set.
    """
    span = length - gram + 1
    trigger = _least(grams, span)
    first = np.empty(len(trigger), dtype=bool)
    first[0] = True
    np.not_equal(trigger[1:], trigger[:-1], out=first[1:])
    first[edges] = True
    at = np.flatnonzero(first)
    count = np.diff(np.append(at, len(trigger)))
    # Places of a trigger that begin a window of the phrase, that end one, and that do both.
    n = len(trigger)
    begins, ends = grams[:n] == trigger, grams[span - 1 :] == trigger
    occurs = np.add.reduceat(begins, at, dtype=np.int32) + np.add.reduceat(ends, at, dtype=np.int32)
    both = np.zeros(n, dtype=bool)
    both[span - 1 :] = begins[span - 1 :] & ends[: max(0, n - span + 1)]
    whole = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(both, out=whole[1:])
    occurs -= np.where(count >= span, whole[at + count] - whole[np.minimum(at + span - 1, n)], 0)
    return trigger[at], at + shift, np.where(occurs > 1, count | AGAIN, count), _fingerprints(raw, at, at + count + length - 1)


def batch_phrases(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, trigger, first window in the row, windows, fingerprint) of the phrases of many texts at once."""
    if len(raw) > PIECE:
        parts = []
        for r, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            t, s, n, f = phrases(raw[a:b], length, gram)
            parts.append((np.full(len(t), r), t, s, n, f))
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    if len(raw) < length:
        return none
    total = _sums(raw)
    at = np.arange(len(raw) - gram + 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = row[: len(raw) - length + 1] == row[length - 1 :]
    marked = np.flatnonzero(np.diff(whole.astype(np.int8), prepend=0, append=0))  # starts and ends of runs of whole windows
    edges = np.unique(np.concatenate([marked, offsets[:-1]]))
    t, s, n, f = _runs(_substrings(total, at, at + gram), raw, edges[edges < len(whole)], length, gram, 0)
    keep = whole[s]
    t, s, n, f = t[keep], s[keep], n[keep], f[keep]
    return row[s], t, s - offsets[row[s]], n, f


# Phrases travel in blocks: arrays of one length each, one after another in one binary value.


def _pack(arrays: list[tuple[np.ndarray, str]]) -> bytes:
    return b"".join(np.ascontiguousarray(a, dtype=t).tobytes() for a, t in arrays)


def _unpack(data: bytes, n: int, kinds: list[str]) -> list[np.ndarray]:
    out, at = [], 0
    for t in kinds:
        out.append(np.frombuffer(data, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


_PHRASE = ["<u4", "<u8", "<i8", "<u4", "<u4"]  # trigger's lower bits, fingerprint, document, first window, windows
BLOCK_DDL = "part int, n int, data binary, doc bigint, a bigint, b bigint, triggers bigint, strings bigint"
BLOCK_NAMES = ["part", "n", "data", "doc", "a", "b", "triggers", "strings"]
_BLOCK_KINDS = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def _batch(**columns) -> pa.RecordBatch:
    n = max(len(v) for v in columns.values())
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(BLOCK_NAMES, _BLOCK_KINDS, strict=True)], names=BLOCK_NAMES)


def _covered(doc: np.ndarray, first: np.ndarray, windows: np.ndarray, length: int, parts: int = 0) -> pa.RecordBatch:
    """Rows of bytes to remove: document, first byte, byte after the last; joined where they meet.

    With parts, each also names a part, to travel with blocks.
    """
    order = np.lexsort((first, doc))
    d, a, b = doc[order], first[order].astype(np.int64), (first[order].astype(np.int64) + windows[order] + length - 1)
    new = np.ones(len(d), dtype=bool)
    top = np.maximum.accumulate(b + _lanes(d)) - _lanes(d) if len(d) else b
    new[1:] = (d[1:] != d[:-1]) | (a[1:] > top[:-1])
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(d)) - 1
    route = {"part": (d[at] % parts).astype(np.int32)} if parts else {}
    return _batch(doc=d[at], a=a[at], b=top[ends], **route)


def _lanes(d: np.ndarray) -> np.ndarray:
    """A step for each distinct document in order, wider than any text, so that running maxima never cross documents."""
    step = np.zeros(len(d), dtype=np.int64)
    step[1:] = np.cumsum(d[1:] != d[:-1])
    return step << 40


def _first_of_each(keys: list[np.ndarray], doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by keys (most significant first), document and place, and whether each is the first of its key."""
    order = np.lexsort((place, doc, *reversed(keys)))
    first = np.zeros(len(order), dtype=bool)
    if len(order):
        first[0] = True
    for k in keys:
        ranked = k[order]
        first[1:] |= ranked[1:] != ranked[:-1]
    return order, first


def _blocks_by_part(part: np.ndarray, arrays: list[tuple[np.ndarray, str]]) -> pa.RecordBatch:
    order = np.argsort(part, kind="stable")
    ranked = part[order]
    at = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, np.int64)
    ends = np.append(at[1:], len(ranked))
    sorted_arrays = [(a[order], t) for a, t in arrays]
    data = [_pack([(a[i:j], t) for a, t in sorted_arrays]) for i, j in zip(at.tolist(), ends.tolist(), strict=True)]
    return _batch(part=ranked[at], n=ends - at, data=data)


def parse(docs: DataFrame, parts: int, length: int = LENGTH) -> DataFrame:
    """Blocks of phrases by part of the triggers, and rows of bytes known to go.

    Of equal phrases within a task only the first goes on.
    """

    def combined(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        doc, trigger, start, count, mark = (np.concatenate(c) for c in zip(*held, strict=True))
        order, first = _first_of_each([trigger, mark], doc, start)
        gone, stay = order[~first], np.sort(order[first])
        if len(gone):
            yield _covered(doc[gone], start[gone], count[gone] & (AGAIN - 1), length, parts)
        part = (trigger[stay] >> np.uint64(32)) % np.uint64(parts)
        yield _blocks_by_part(part.astype(np.int64), [(trigger[stay] & np.uint64(0xFFFFFFFF), "<u4"), (mark[stay], "<u8"), (doc[stay], "<i8"), (start[stay], "<u4"), (count[stay], "<u4")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for chunk in W.text_chunks(batch, "text", PIECE):
                row, trigger, start, count, mark = batch_phrases(*W.utf8_buffer(chunk.column("text")), length)
                doc = chunk.column("doc").to_numpy()[row]
                held.append((doc, trigger, start, count, mark))
                n += len(doc)
                if n >= COMBINE:
                    yield from combined(held)
                    held, n = [], 0
        if n:
            yield from combined(held)

    return docs.select("doc", "text").mapInArrow(W.tidy(run), BLOCK_DDL)


def _only_blocks(batches: Iterator[pa.RecordBatch], passed: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks; rows of bytes to remove that travel with them are put into ``passed``."""
    for batch in batches:
        block = batch.column("data").is_valid()
        rows = batch.filter(pc.invert(block))
        if rows.num_rows:
            passed.append(rows.set_column(0, "part", pa.nulls(rows.num_rows, pa.int32())))
        yield batch.filter(block)


def _each_part(batches: Iterator[pa.RecordBatch], kinds: list[str], most: int) -> Iterator[tuple[int, list[np.ndarray], bool]]:
    """The blocks of each part together, from rows sorted by part; a part of over ``most`` comes in several, the flag being set."""
    now, held, n, split = None, [], 0, False

    def together() -> list[np.ndarray]:
        return [np.concatenate(c) for c in zip(*held, strict=True)]

    for batch in batches:
        for part, count, data in zip(batch.column("part").to_pylist(), batch.column("n").to_pylist(), batch.column("data").to_pylist(), strict=True):
            if part != now or n >= most:
                split = split or part == now
                if held:
                    yield now, together(), split
                split, now, held, n = split and part == now, part, [], 0
            held.append(_unpack(data, count, kinds))
            n += count
    if held:
        yield now, together(), split


def dictionary(blocks: DataFrame, parts: int, length: int = LENGTH) -> DataFrame:
    """Rows of bytes known to go, and phrases still to compare: doc, first window a, windows b, their trigger and how many phrases share it.

    Part by part, equal phrases are put together.  A part too large for memory
    comes in pieces, none of which knows how many phrases share a trigger: it
    passes all its phrases on, to be compared window by window, with one count
    for them all, as windows() finds equal windows by trigger and count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []
        for part, (trigger, mark, doc, start, count), split in _each_part(_only_blocks(batches, passed), _PHRASE, 8 * COMBINE):
            while passed:
                yield passed.pop()
            order, first = _first_of_each([trigger, mark], doc, start)
            gone, stay = order[~first], order[first]
            again = (count & AGAIN) > 0
            count = (count & (AGAIN - 1)).astype(np.int64)
            if len(gone):
                yield _covered(doc[gone], start[gone], count[gone], length)
            kept = trigger[stay]
            new = np.append(True, kept[1:] != kept[:-1])
            group = np.cumsum(new) - 1
            strings = np.bincount(group)[group] if len(group) else group
            weight = (np.bincount(group, count[stay] + length - 1)[group] // PHRASE_BYTES).astype(np.int64) if len(group) else group
            go_on = np.flatnonzero((strings > 1) | again[stay] | split)
            if len(go_on):
                stay = stay[go_on]
                yield _batch(doc=doc[stay], a=start[stay].astype(np.int64), b=count[stay], triggers=trigger[stay].astype(np.int64) * parts + part, strings=np.full(len(stay), SPLIT * parts) if split else np.maximum(strings, weight)[go_on])

        while passed:
            yield passed.pop()

    return blocks.repartition(shuffle_partitions(blocks.sparkSession), "part").sortWithinPartitions("part").mapInArrow(W.tidy(run), BLOCK_DDL)


_STRINGS = ["<i8", "<u4", "<u4"]  # document, first window, windows; then the strings' bytes


def _strings(doc: np.ndarray, place: np.ndarray, windows: np.ndarray, raw: bytes) -> bytes:
    return _pack([(doc, "<i8"), (place, "<u4"), (windows, "<u4")]) + raw


def _cut_out(raw, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Pieces of a buffer, one after another."""
    with memoryview(raw) as view:
        return b"".join([view[x:y] for x, y in zip(starts.tolist(), ends.tolist(), strict=True)])


def _in_corpus_order(blocks: list[tuple[int, bytes]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, windows) of the strings of some blocks, by corpus place, and their bytes in that order."""
    heads = [_unpack(data, n, _STRINGS) for n, data in blocks]
    doc, place, windows = (np.concatenate(c) for c in zip(*heads, strict=True))
    raw = b"".join([memoryview(data)[16 * n :] for n, data in blocks])
    windows = windows.astype(np.int64)
    ends = np.cumsum(windows + length - 1)
    order = np.lexsort((place, doc))
    raw = _cut_out(raw, (ends - windows - length + 1)[order], ends[order])
    return doc[order], place[order], windows[order], np.frombuffer(raw, np.uint8)


def _dense(key: np.ndarray) -> np.ndarray:
    """The rank of each key among the distinct ones."""
    order = np.argsort(key)
    ranked = key[order]
    new = np.empty(len(key), dtype=bool)
    new[0] = False
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    del ranked
    rank = np.empty(len(key), dtype=np.int32)
    rank[order] = np.cumsum(new, dtype=np.int32)
    return rank


def suffix_ranks(raw: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The rank of every suffix of at least ``length`` bytes by its first ``length`` bytes, by prefix doubling."""
    depth = min(8, length)
    n = len(raw) - depth + 1
    key = np.zeros(n, dtype=np.uint64)
    for k in range(depth):
        key <<= np.uint64(8)
        key |= raw[k : k + n]
    rank = _dense(key)
    while depth < length:
        step = min(depth, length - depth)
        n = len(rank) - step
        key = rank[:n].astype(np.int64)
        key *= int(rank.max()) + 1
        key += rank[step:]
        rank = _dense(key)
        depth += step
    return rank


def _again(raw: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """For the windows of strings laid one after another, whether an equal one came before."""
    if not len(windows):
        return np.zeros(0, bool)
    size = windows + length - 1
    at = np.repeat(np.cumsum(size) - size - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
    rank = suffix_ranks(raw, length)[at]
    first, own = np.empty(int(rank.max()) + 1, dtype=np.int64), np.arange(len(rank))
    first[rank[::-1]] = own[::-1]
    return first[rank] != own


def windows(todo: DataFrame, parts: int, length: int = LENGTH) -> DataFrame:
    """Blocks of the dictionary phrases as strings, and rows of bytes known to go.

    todo: doc, text and phrases, an array of (a, b, triggers, strings).  A
    phrase of a trigger that has too many goes as its windows, but for those
    equal to an earlier one within the task.  Strings have PHRASE_BYTES windows
    each at most, so a piece of such a trigger has SPLIT * PHRASE_BYTES bytes
    at most, as has a trigger that stays whole.
    """

    def blocks(part: np.ndarray, doc: np.ndarray, place: np.ndarray, count: np.ndarray, raw: np.ndarray) -> pa.RecordBatch:
        size = count.astype(np.int64) + length - 1
        at = np.cumsum(size) - size
        order = np.argsort(part, kind="stable")
        ranked = part[order]
        first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        ends = np.append(first[1:], len(ranked))
        raw = _cut_out(raw, at[order], (at + size)[order])
        doc, place, count, size = doc[order], place[order], count[order], size[order]
        bounds = np.concatenate([[0], np.cumsum(size)])
        data = [_strings(doc[i:j], place[i:j], count[i:j], raw[bounds[i] : bounds[j]]) for i, j in zip(first.tolist(), ends.tolist(), strict=True)]
        return _batch(part=ranked[first], n=ends - first, data=data)

    def dealt(key: np.ndarray, piece: np.ndarray | int) -> np.ndarray:
        salted = W.mix(key.astype(np.uint64) + np.asarray(piece, np.uint64) * np.uint64(_ROLL))
        return (salted % np.uint64(parts)).astype(np.int64)

    def whole(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        doc, place, count, trigger, _ = (np.concatenate([h[k] for h in held]) for k in range(5))
        yield blocks(dealt(trigger, 0), doc, place, count, np.concatenate([h[5] for h in held]))

    def apart(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        doc, place, count, trigger, strings = (np.concatenate([h[k] for h in held]) for k in range(5))
        raw = np.concatenate([h[5] for h in held])
        order = np.lexsort((place, doc))
        size = count + length - 1
        ends = np.cumsum(size)
        raw = np.frombuffer(_cut_out(raw, (ends - size)[order], ends[order]), np.uint8)
        doc, place, count, trigger, strings, size = (c[order] for c in (doc, place, count, trigger, strings, size))
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = np.repeat(np.cumsum(size) - size, count) + inner
        doc, place, trigger, pieces = np.repeat(doc, count), np.repeat(place, count) + inner, np.repeat(trigger, count), np.repeat(strings * length // SPLIT + 1, count)
        gone = _again(raw, count, length)
        one = np.ones(len(doc), np.int64)
        if gone.any():
            yield _covered(doc[gone], place[gone], one[gone], length, parts)
        stay = np.flatnonzero(~gone)
        total = _sums(raw)
        for k in range(0, len(stay), COMBINE // 4):
            own = stay[k : k + COMBINE // 4]
            mark = _substrings(total, start[own], start[own] + length)
            views = np.lib.stride_tricks.sliding_window_view(raw, length)
            yield blocks(dealt(trigger[own], (mark >> np.uint64(20)) % pieces[own].astype(np.uint64)), doc[own], place[own], one[own], views[start[own]].ravel())

    def of_text(raw: np.ndarray, doc: int, a: np.ndarray, b: np.ndarray, trigger: np.ndarray, strings: np.ndarray) -> tuple:
        return np.full(len(a), doc), a, b, trigger, strings, np.frombuffer(_cut_out(raw, a, a + b + length - 1), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[tuple]] = {True: [], False: []}
        n = {True: 0, False: 0}
        passed_on = {True: apart, False: whole}
        for batch in batches:
            for chunk in W.text_chunks(batch, "text", PIECE):
                raw, offsets = W.utf8_buffer(chunk.column("text"))
                lists = chunk.column("phrases")
                inner, bounds = lists.flatten(), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))])
                columns = [inner.field(k).to_numpy() for k in range(4)]
                for r, doc in enumerate(chunk.column("doc").to_pylist()):
                    own = [c[bounds[r] : bounds[r + 1]] for c in columns]
                    many = own[3] >= SPLIT
                    for split in (False, True):
                        a, b, trigger, strings = (c[many == split] for c in own)
                        for k in range(0, len(a), STRINGS):  # a long text's, some at a time
                            piece = slice(k, k + STRINGS)
                            found = of_text(raw[offsets[r] : offsets[r + 1]], doc, a[piece], b[piece], trigger[piece], strings[piece])
                            held[split].append(found)
                            n[split] += len(found[5])
                            if n[split] >= 4 * COMBINE:
                                yield from passed_on[split](held[split])
                                held[split], n[split] = [], 0
        for split in (False, True):
            if held[split]:
                yield from passed_on[split](held[split])

    return todo.mapInArrow(W.tidy(run), BLOCK_DDL)


def ordered(blocks: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows of bytes known to go: all but the first in corpus order of the windows of each rank."""

    def one(held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        doc, place, count, raw = _in_corpus_order(held, length)
        gone = _again(raw, count, length)
        if gone.any():
            inner = np.arange(len(gone)) - np.repeat(np.cumsum(count) - count, count)
            doc, place = np.repeat(doc, count)[gone], (np.repeat(place, count) + inner)[gone]
            yield _covered(doc, place, np.ones(len(doc), np.int64), length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []
        now, held = None, []
        for batch in _only_blocks(batches, passed):
            for part, n, data in zip(batch.column("part").to_pylist(), batch.column("n").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if part != now and held:
                    yield from one(held)
                    held = []
                now = part
                held.append((n, data))
            while passed:
                yield passed.pop()
        if held:
            yield from one(held)
        while passed:
            yield passed.pop()

    return blocks.repartition(shuffle_partitions(blocks.sparkSession), "part").sortWithinPartitions("part").mapInArrow(W.tidy(run), BLOCK_DDL)


def _joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans joined where they meet or overlap."""
    order = np.argsort(a, kind="stable")
    a, top = a[order], np.maximum.accumulate(b[order])
    new = np.append(True, a[1:] > top[:-1])
    at = np.flatnonzero(new)
    return a[at], top[np.append(at[1:], len(a)) - 1]


def numbered(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, and doc, a number that is unique and in the order of ids.

    The id itself where it is never null nor repeated; else rows are written
    in order and numbered.
    """
    own = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    n, named, different = own.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if n == named == different and dict(own.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint"):
        return own.withColumn("doc", F.col("doc_id").cast("bigint"))
    in_order = own.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id")
    return written(in_order.withColumn("doc", F.monotonically_increasing_id()), "numbered")[0]


def repeats(docs: DataFrame, length: int = LENGTH, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """For each numbered document that loses bytes: doc and spans, an array of (a, b)."""
    parts = 16 * shuffle_partitions(docs.sparkSession)
    found, _ = written(dictionary(parse(docs, parts, length), parts, length), "dictionary")
    todo = found.filter("triggers is not null").groupBy("doc").agg(F.collect_list(F.struct("a", "b", "triggers", "strings")).alias("phrases"))
    todo, _ = written(todo, "dictionary-phrases")
    parts = ranked_parts(todo, parts, length)
    texts = docs.select("doc", "text").join(broadcast_if_small(todo, in_memory(todo, "phrases", 48), broadcast_bytes), "doc")
    last, _ = written(ordered(windows(texts, parts, length), length), "windows-in-order")
    gone = found.filter("triggers is null").unionByName(last).select("doc", "a", "b")
    return gone.groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def ranked_parts(todo: DataFrame, parts: int, length: int = LENGTH) -> int:
    """In how many parts the phrases of ``todo`` are ranked: as many as have RANKED bytes each, ``parts`` at least."""
    size = F.aggregate("phrases", F.lit(0).cast("bigint"), lambda n, p: n + F.when(p["strings"] >= SPLIT, p["b"] * length).otherwise(p["b"] + length - 1))
    return max(parts, (todo.agg(F.sum(size)).first()[0] or 0) // RANKED)


def in_memory(table: DataFrame, lists: str, each: int) -> int:
    """About the bytes that a table of ids and lists takes when broadcast."""
    rows, items = table.agg(F.count("*"), F.sum(F.size(lists))).first()
    return 100 * rows + each * (items or 0)


def cut(docs: DataFrame, spans: DataFrame, nbytes: int, keep_text: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Numbered documents with their spans cut out: doc_id, counts, a digest, and kept, the bytes left, if asked for."""
    joined = docs.join(broadcast_if_small(spans, nbytes, broadcast_bytes), "doc", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in W.text_chunks(batch, "text"):
                raw, offsets = W.utf8_buffer(chunk.column("text"))
                rows = []
                for r, found in enumerate(chunk.column("spans")):
                    own = raw[offsets[r] : offsets[r + 1]]
                    removed, count, left = 0, 0, own.tobytes()
                    if found.is_valid and len(found.values):
                        a, b = _joined(found.values.field(0).to_numpy(), found.values.field(1).to_numpy())
                        removed, count = int((b - a).sum()), len(a)
                        edges = np.concatenate([[0], np.column_stack([a, b]).ravel(), [len(own)]]).tolist()
                        left = b"".join(left[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                    rows.append((len(own), removed, count, hashlib.sha256(left).hexdigest(), left if keep_text else None))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), *columns[: 5 if keep_text else 4]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if keep_text else 5])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "text", "spans").mapInArrow(W.tidy(run), f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep_text)


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_text: bool = False, doc: str = "doc_id", text: str = "text") -> DataFrame:
    own = numbered(docs, doc, text)
    spans, _ = written(repeats(own, length), "removed-spans")
    return cut(own, spans, in_memory(spans, "spans", 32), keep_text)


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(tables(spark, sf_dir, "documents"))
