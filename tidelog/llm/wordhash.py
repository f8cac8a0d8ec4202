"""Vectorised word and shingle hashing over Arrow string columns.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; A-Z counts as
a-z.  UTF-8 continuation bytes are never in that set, so byte-wise splitting
equals splitting by code point.  All hashes are 64 bit.  A word or line is
hashed by tabulation: every byte at every place has a value of its own, drawn
by a mixer, and the hash is the mixed sum of them.  No algebra ties the values
together, so texts of a regular build (such as one word and its mirror under
a swap of letters) clash no more often than chance has it, 2 ** -64 a pair,
which a polynomial modulo 2 ** 64 can't promise.  A shingle folds its words'
hashes in one by one with a mixer between.  Texts are hashed in pieces cut at
white space, so memory stays near ``PIECE`` times a small constant whatever
the text length is.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time.
PIECE = 1 << 18
#: Bytes of text handed on together by :func:`text_chunks`.
CHUNK = 1 << 20

SHINGLE_WORDS = 5

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0xD1342543DE82EF95)
#: Places whose byte values are kept in a table; those further on are computed.
PLACES = 256
BLANK, NEWLINE = b" \t\n\v\f\r", b"\n"

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


@cache
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # not glibc
        return lambda _: 0


def give_back() -> None:
    """Returns memory that was freed to the system, so that workers kept for later tasks stay small."""
    _trim()(0)
    pa.default_memory_pool().release_unused()


def tidy(run: Callable[[Iterator], Iterator], every: int = 16) -> Callable[[Iterator], Iterator]:
    """The same generator of batches, giving memory back now and then and at its end."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, out in enumerate(run(batches), 1):
            yield out
            if k % every == 0:
                give_back()
        give_back()

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _fold(lower: bool) -> np.ndarray:
    """The byte that each byte counts as."""
    fold = np.arange(256, dtype=np.uint64)
    if lower:
        fold[ord("A") : ord("Z") + 1] += np.uint64(32)
    return fold


@cache
def _values(lower: bool, blank: bytes) -> np.ndarray:
    """The value of byte b at place p, at 256 p + b, for the first places; 0 for bytes that end a unit."""
    keys = np.arange(PLACES, dtype=np.uint64)[:, None] * np.uint64(256) + _fold(lower)
    values = mix((keys + np.uint64(1)) * _STEP)
    values[:, list(blank)] = 0
    return values.ravel()


def _unit_hashes(piece: np.ndarray, at: np.ndarray, lower: bool, blank: bytes) -> np.ndarray:
    """The hash of each unit of a piece, from its first byte, given in ``at``, to the next one's; blank bytes don't count."""
    lengths = np.diff(np.append(at, len(piece)))
    place = np.arange(at[0], len(piece), dtype=np.int64)
    place -= np.repeat(at, lengths)
    own = piece[at[0] :]
    value = _values(lower, blank).take(place * 256 + own, mode="clip")
    if lengths.max() > PLACES:
        far = np.flatnonzero(place >= PLACES)
        value[far] = 0
        far = far[~np.isin(own[far], np.frombuffer(blank, np.uint8))]
        value[far] = mix((place[far].astype(np.uint64) * np.uint64(256) + _fold(lower)[own[far]] + np.uint64(1)) * _STEP)
    return mix(np.add.reduceat(value, at - at[0]))


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its row offsets into them; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def text_chunks(batch: pa.RecordBatch, name: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` bytes of text, a row at least."""
    _, offsets = utf8_buffer(batch.column(name))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def _cuts(raw: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces of about PIECE bytes, each but the last followed by a byte of ``ends``."""
    at = 0
    while at < len(raw):
        end = at + PIECE
        while end < len(raw):
            blank = np.flatnonzero(ends[raw[end : end + PIECE]])
            if len(blank):
                end += int(blank[0])
                break
            end += PIECE
        end = min(end, len(raw))
        yield at, end
        at = end


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, first byte of each word, first word of each row and the total)."""
    hashes, starts = [], []
    edges = offsets[:-1][np.diff(offsets) > 0]
    for a, b in _cuts(raw, SPACE):
        piece = raw[a:b]
        word = ~SPACE[piece]
        first = word.copy()
        first[1:] &= ~word[:-1]
        inner = edges[np.searchsorted(edges, a) : np.searchsorted(edges, b)] - a
        first[inner] = word[inner]
        at = np.flatnonzero(first)
        if len(at):
            hashes.append(_unit_hashes(piece, at, lower, BLANK))
            starts.append(at + a)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return h, s, np.searchsorted(s, offsets)


def line_hashes(raw: np.ndarray, offsets: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, first line of each row and the total, whether it has a word) of \\n-split lines.

    ``words``: the first byte of each word.  An empty last line of a piece is left out; it has no word.
    """
    hashes, starts = [], []
    edges = offsets[:-1][np.diff(offsets) > 0]
    newline = np.arange(256) == 10
    for a, b in _cuts(raw, newline):
        piece = raw[a:b]
        first = np.zeros(b - a, dtype=bool)
        first[1:] = newline[piece[:-1]]
        first[0] = True
        first[edges[np.searchsorted(edges, a) : np.searchsorted(edges, b)] - a] = True
        at = np.flatnonzero(first)
        hashes.append(_unit_hashes(piece, at, False, NEWLINE))
        starts.append(at + a)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    ends = np.append(s[1:], len(raw))
    worded = np.searchsorted(words, s) < np.searchsorted(words, ends[: len(s)])
    return h, s, np.searchsorted(s, offsets), worded


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        total += words[k : k + len(total)]
        total *= _M1
        total ^= total >> np.uint64(32)
    return mix(total)


def shingle_sets(column: pa.Array, n: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """For each row the ascending distinct hashes of its n-word shingles.

    A row of fewer words has its whole sequence as its one shingle; one
    without words, or null, has none.
    """
    raw, offsets = utf8_buffer(column)
    words, _, rows = word_hashes(raw, offsets)
    runs = window_hashes(words, n)
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= n:
            found = np.sort(runs[a : b - n + 1])
            keep = np.empty(len(found), dtype=bool)
            keep[0] = True
            np.not_equal(found[1:], found[:-1], out=keep[1:])
            yield found[keep]
        elif b > a:
            yield window_hashes(words[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)
