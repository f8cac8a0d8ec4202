"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A text is split into pretokens; each distinct pretoken is encoded once by the
library and its ids are kept, so most of a text is table look-ups.  Texts of
plain characters are split by a pattern of the standard library that agrees
with the usual pattern of byte-level vocabularies on them; any other text, and
every text of a tokenizer with a pattern of its own, is split by that pattern
or by the tokenizer itself.  A text with the string of an added token goes to
the tokenizer as a whole.

Null texts count as empty and have no ids.  Texts are encoded whole, very long
ones alone.  Of pairs of equal rank the first merges, and no two pairs of
different rank tie.  Repeated rows are encoded alike, ids of documents may be
null, an empty table gives no rows and other columns are ignored, or kept by
the functions on frames; there own columns named ids, starts, ends or data give
way to the new ones.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.common import map_batches, tables

#: Pretokens kept by an encoder before it starts afresh, with those of the texts at hand.
CACHE_WORDS = 700_000
#: Characters of text split before their pretokens are looked up, and pretokens encoded in one text.
TEXT_CHARS = 1 << 20
JOIN_WORDS = 64
#: Pretokens longer than this are encoded each time.
CACHE_CHARS = 64

#: Texts of these characters alone are split by the standard library; on them the classes below are \p{L}, \p{N} and \s.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
_ODD = re.compile(rf"[^\t\n\r\x20-\x7e{_LETTERS}]")
#: The pattern that _PLAIN agrees with, a fixed value.
USUAL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PLAIN = re.compile(rf" ?[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^{_LETTERS}0-9\t\n\r ]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+")

@cache
def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves; the others, in order, take the
    characters from 256 on.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


@cache
def character_bytes() -> dict[str, int]:
    return {c: b for b, c in byte_characters().items()}


def _quiet() -> None:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merges_of(ranks: dict[bytes, int]) -> Iterator[tuple[bytes, bytes]]:
    """Every pair of tokens that makes a token, by the rank of what it makes."""
    for token in sorted(ranks, key=ranks.__getitem__):
        for k in range(1, len(token)):
            if token[:k] in ranks and token[k:] in ranks:
                yield token[:k], token[k:]


class Encoder:
    """Encodes texts to ids and ids back to bytes.

    tokenizer: of the tokenizers library; it must encode each pretoken as it
    would within a text.  split: the pattern for odd texts, or None if the
    tokenizer itself splits those.  usual: whether plain texts may be split by
    the standard library.
    """

    def __init__(self, tokenizer, split=None, usual: bool = False):
        self.tokenizer, self.split, self.usual = tokenizer, split, usual
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        back = character_bytes()
        size = tokenizer.get_vocab_size(with_added_tokens=True)
        names = [tokenizer.id_to_token(k) or "" for k in range(size)]
        special = {k for k, t in tokenizer.get_added_tokens_decoder().items()}
        self.table = [t.encode() if k in special else bytes(back[c] for c in t) for k, t in enumerate(names)]
        self.known: dict[str, bytes] = {}
        ids = tokenizer.encode("\n", add_special_tokens=False).ids
        apart = split is None and len(ids) == 1 and tokenizer.encode("a\n b\n", add_special_tokens=False).ids.count(ids[0]) == 2
        self.line_break = ids[0] if apart else None

    def _learn(self, words: set[str]) -> None:
        """Encodes words that are not known yet; runs of letters many in one text, a line break after each."""
        joined, rest = [], []
        for w in words:
            (joined if self.line_break is not None and w[-1].isalpha() and w[0] != "'" else rest).append(w)
        known = self.known
        for at in range(0, len(joined), JOIN_WORDS):
            group = joined[at : at + JOIN_WORDS]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join([*group, ""])], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.line_break)
            if len(ends) != len(group):
                raise ValueError("the tokenizer joins words over line breaks")
            packed, start = ids.tobytes(), 0
            for w, end in zip(group, (4 * ends).tolist(), strict=True):
                known[w] = packed[start:end]
                start = end + 4
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, dtype="<u4").tobytes()

    def pretokens(self, text: str) -> list[str] | None:
        """The text's pretokens, or None if the tokenizer must split it."""
        if any(a in text for a in self.added):
            return None
        if self.usual and _ODD.search(text) is None:
            return _PLAIN.findall(text)
        return self.split.findall(text) if self.split else None

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        held: list[tuple[str, list[str] | None]] = []
        size = 0
        for text in texts:
            held.append((text, self.pretokens(text)))
            size += len(text)
            if size >= TEXT_CHARS:
                yield from self._encode(held)
                held, size = [], 0
        yield from self._encode(held)

    def _encode(self, held: list[tuple[str, list[str] | None]]) -> Iterator[bytes]:
        looked_up: list[tuple[list[bytes | None], list[int]]] = []
        unseen: set[str] = set()
        for _, own in held:
            got = list(map(self.known.get, own or ()))
            gaps = [k for k, ids in enumerate(got) if ids is None]
            unseen.update([own[k] for k in gaps])
            looked_up.append((got, gaps))
        if len(self.known) + len(unseen) > CACHE_WORDS:  # the words of these texts stay, the common ones among them
            self.known = {w: ids for (_, own), (got, _) in zip(held, looked_up, strict=True) for w, ids in zip(own or (), got, strict=True) if ids is not None}
        if unseen:
            self._learn({w for w in unseen if len(w) <= CACHE_CHARS})
        for (text, own), (got, gaps) in zip(held, looked_up, strict=True):
            if own is None:
                yield self._alone(text)
                continue
            for k in gaps:
                got[k] = self.known[own[k]] if len(own[k]) <= CACHE_CHARS else self._alone(own[k])
            yield b"".join(got)

    def _alone(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids; a character split over ids comes together here."""
        return b"".join(map(self.table.__getitem__, ids))


@cache
def json_encoder(path: str) -> Encoder:
    """Of a tokenizer file, as the library reads it."""
    _quiet()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    told = json.loads(tokenizer.to_str())
    splits = told["pre_tokenizer"] or {}
    usual = told["normalizer"] is None and splits.get("type") == "ByteLevel" and splits.get("use_regex", True) and not splits.get("add_prefix_space")
    return Encoder(tokenizer, usual=bool(usual))


@cache
def ranks_encoder(path: str, pattern: str) -> Encoder:
    """Of a rank file: a pretoken that is a token is one id; else the pair of least rank merges first."""
    _quiet()
    import regex
    from tokenizers import Tokenizer, models, pre_tokenizers

    ranks = read_ranks(path)
    names = {t: "".join(map(byte_characters().__getitem__, t)) for t in ranks}
    model = models.BPE({names[t]: r for t, r in ranks.items()}, [(names[a], names[b]) for a, b in merges_of(ranks)], ignore_merges=True)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return Encoder(tokenizer, regex.compile(pattern), usual=pattern == USUAL_PATTERN)


def offsets(table: list[bytes], ids: list[int]) -> tuple[list[int], list[int]]:
    """Each token's first character and the one after its last, in the decoded text.

    A token that holds only part of a character covers that character.
    """
    starts, ends, at = [], [], 0
    for piece in map(table.__getitem__, ids):
        first = sum((b & 0xC0) != 0x80 for b in piece)
        inside = bool(piece) and (piece[0] & 0xC0) == 0x80
        starts.append(at - inside)
        at += first
        ends.append(at)
    return starts, ends


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    return [t or "" for t in batch.column(name).to_pylist()]


def encode_frame(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """The frame with ids, and starts and ends in characters, in place of the text."""
    rest = [f for f in docs.schema.fields if f.name not in (text, "ids", "starts", "ends")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = ranks_encoder(path, pattern)
        ids = [np.frombuffer(i, "<u4").tolist() for i in encoder.encode(texts_of(batch, text))]
        places = [offsets(encoder.table, i) for i in ids]
        kind = pa.list_(pa.int32())
        new = [pa.array(ids, kind), pa.array([p[0] for p in places], kind), pa.array([p[1] for p in places], kind)]
        return pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), *new], names=[*(f.name for f in rest), "ids", "starts", "ends"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + [f"{c} array<int>" for c in ("ids", "starts", "ends")]
    return map_batches(docs, run, ", ".join(kinds), text)


def decode_frame(coded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """The frame with the decoded bytes, ``data``, in place of the ids."""
    rest = [f for f in coded.schema.fields if f.name not in (ids, "data")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ranks_encoder(path, pattern)
        for batch in batches:
            data = pa.array([encoder.decode(i or []) for i in batch.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), data], names=[*(f.name for f in rest), "data"])

    return coded.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + ["data binary"]))


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes decoded from them."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = ranks_encoder(path, pattern)
        said = _numerals(len(encoder.table))
        counts, coded, decoded = [], [], []
        for packed in encoder.encode(texts_of(batch, text)):
            ids = np.frombuffer(packed, "<u4").tolist()
            counts.append(len(ids))
            coded.append(hashlib.sha256(b",".join(map(said.__getitem__, ids))).hexdigest())
            decoded.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", text), run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", text)


@cache
def _numerals(n: int) -> list[bytes]:
    return [b"%d" % k for k in range(n)]


def multilingual() -> tuple[str, str]:
    """The default rank file and pattern; pass others to the functions above as needed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(tables(spark, sf_dir, "documents"), *multilingual())
