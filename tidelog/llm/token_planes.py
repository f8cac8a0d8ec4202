"""Token ids in binary files: bit or byte planes of fixed-size blocks, with a chunk index.

A file holds the ids of many documents one after another, as unsigned 32-bit
integers.  They are cut into blocks of ``BLOCK_IDS``; a block is transposed
into planes, one for each bit or byte, each plane is compressed with
zstandard, and planes above the highest in use are left out.  Byte planes are the default, being
smaller here and faster.  The index at
the end says where each chunk lies and what documents the file holds, so that
one chunk or one document can be read alone.

    file    = magic, chunks, index, trailer
    chunk   = planes, one zstandard frame each, lowest bit or byte first
    index   = zstandard frame of: JSON header, then arrays named in it
    trailer = offset and length of the index, crc32 of it, magic

A file ends at ``FILE_BYTES`` or ``FILE_DOCUMENTS``, so that neither its index
nor the task that reads it grows with the corpus; a document is in one file.

Null texts count as empty and have only the end id.  Texts are encoded whole;
memory is bounded by a block and the text at hand.  The strings of special
tokens are what the library makes of them, their own ids.  doc_id must be a
whole number and is read back as bigint.  Rows of one doc_id keep
apart, in any order; null ids come first; an empty table writes no files and
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidelog.llm.bpe import json_encoder, texts_of
from tidelog.llm.common import new_folder, shuffle_partitions, tables, written
from tidelog.llm.storage import new_file, own_name, reader
from tidelog.llm.wordhash import text_chunks

MAGIC = b"IDPLANE1"
BLOCK_IDS = 1 << 16
LEVEL = 1
FILE_BYTES = 64 << 20
FILE_DOCUMENTS = 1 << 20
END_ID = 0
_TRAILER = struct.Struct("<QQI8s")


def to_planes(ids: np.ndarray, unit: str) -> list[bytes]:
    """The block's planes, lowest first, up to the highest that is not all zero."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    if unit == "byte":
        columns = ids.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4)
        return [columns[:, k].tobytes() for k in range(-(-top // 8))]
    wide = np.unpackbits(ids.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return [p.tobytes() for p in np.packbits(np.ascontiguousarray(wide[:, :top].T), axis=1, bitorder="little")]


def from_planes(planes: list[bytes], n: int, unit: str) -> np.ndarray:
    """The n ids that the planes hold."""
    if unit == "byte":
        columns = np.zeros((n, 4), dtype=np.uint8)
        for k, p in enumerate(planes):
            columns[:, k] = np.frombuffer(p, dtype=np.uint8)
        return columns.reshape(-1).view("<u4")
    wide = np.zeros((32, n), dtype=np.uint8)
    for k, p in enumerate(planes):
        wide[k] = np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n, bitorder="little")
    return np.packbits(np.ascontiguousarray(wide.T), axis=1, bitorder="little").reshape(-1).view("<u4")


@dataclass
class Writer:
    """Takes documents in order and writes one file."""

    out: pa.NativeFile
    unit: str = "byte"
    block: int = BLOCK_IDS
    held: list[np.ndarray] = field(default_factory=list)
    n_held: int = 0
    at: int = len(MAGIC)
    chunk_at: list[int] = field(default_factory=list)
    chunk_ids: list[int] = field(default_factory=list)
    plane_bytes: list[list[int]] = field(default_factory=list)
    documents: list[int | None] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)

    def __post_init__(self):
        self.out.write(MAGIC)
        self.press = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, document: int | None, ids: np.ndarray) -> None:
        self.documents.append(document)
        self.lengths.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            every = np.concatenate(self.held)
            whole = len(every) // self.block * self.block
            for k in range(0, whole, self.block):
                self._chunk(every[k : k + self.block])
            self.held, self.n_held = [every[whole:].copy()], len(every) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        frames = [self.press.compress(p) for p in to_planes(ids, self.unit)]
        self.chunk_at.append(self.at)
        self.chunk_ids.append(len(ids))
        self.plane_bytes.append([len(f) for f in frames])
        for f in frames:
            self.out.write(f)
            self.at += len(f)

    def close(self) -> int:
        """Ends the file; the number of ids in it."""
        if self.n_held:
            self._chunk(np.concatenate(self.held))
        arrays = {
            "chunk_at": np.array(self.chunk_at, "<u8"),
            "chunk_ids": np.array(self.chunk_ids, "<u4"),
            "planes": np.array([len(p) for p in self.plane_bytes], "<u1"),
            "plane_bytes": np.array([b for p in self.plane_bytes for b in p], "<u4"),
            "documents": np.array([d or 0 for d in self.documents], "<i8"),
            "named": np.array([d is not None for d in self.documents], "<u1"),
            "lengths": np.array(self.lengths, "<u8"),
        }
        header = json.dumps({"unit": self.unit, "block": self.block, "arrays": [[k, v.dtype.str, len(v)] for k, v in arrays.items()]}).encode()
        index = self.press.compress(struct.pack("<I", len(header)) + header + b"".join(v.tobytes() for v in arrays.values()))
        self.out.write(index)
        self.out.write(_TRAILER.pack(self.at, len(index), zlib.crc32(index), MAGIC))
        return sum(self.lengths)


class Reader:
    """Reads a file's index, then chunks or documents as asked."""

    def __init__(self, source: pa.NativeFile):
        self.source = source
        size = source.size()
        source.seek(size - _TRAILER.size)
        at, length, crc, magic = _TRAILER.unpack(source.read(_TRAILER.size))
        source.seek(at)
        packed = source.read(length)
        if magic != MAGIC or zlib.crc32(packed) != crc:
            raise ValueError("not a complete file of token planes")
        raw = zstandard.ZstdDecompressor().decompress(packed)
        (n,) = struct.unpack_from("<I", raw)
        self.header = json.loads(raw[4 : 4 + n])
        at = 4 + n
        for name, kind, count in self.header["arrays"]:
            setattr(self, name, np.frombuffer(raw, kind, count, at))
            at += count * np.dtype(kind).itemsize
        self.open = zstandard.ZstdDecompressor()
        self.first_plane = np.concatenate([[0], np.cumsum(self.planes.astype(np.int64))])
        self.first_id = np.concatenate([[0], np.cumsum(self.chunk_ids.astype(np.int64))])
        self.starts = np.concatenate([[0], np.cumsum(self.lengths.astype(np.int64))])

    def chunk(self, k: int) -> np.ndarray:
        sizes = self.plane_bytes[self.first_plane[k] : self.first_plane[k + 1]].tolist()
        self.source.seek(int(self.chunk_at[k]))
        raw, planes, at = self.source.read(sum(sizes)), [], 0
        for s in sizes:
            planes.append(self.open.decompress(raw[at : at + s]))
            at += s
        return from_planes(planes, int(self.chunk_ids[k]), self.header["unit"])

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids of the file from start to before end, from the chunks that hold them."""
        a, b = np.searchsorted(self.first_id, [start, max(start, end - 1)], side="right") - 1
        parts = [self.chunk(k) for k in range(a, min(b, len(self.chunk_ids) - 1) + 1)] if end > start else []
        return np.concatenate(parts)[start - self.first_id[a] :][: end - start] if parts else np.zeros(0, "<u4")

    def documents_in_order(self) -> Iterator[tuple[int | None, int, Iterator[np.ndarray]]]:
        """(id, first id's place, pieces of the ids) of each document; the pieces must be used up in turn."""
        k, have, at = 0, np.zeros(0, "<u4"), 0

        def pieces(left: int) -> Iterator[np.ndarray]:
            nonlocal k, have, at
            while left:
                if at == len(have):
                    have, at, k = self.chunk(k), 0, k + 1
                part = have[at : at + left]
                at, left = at + len(part), left - len(part)
                yield part

        for d, named, start, n in zip(self.documents.tolist(), self.named.tolist(), self.starts.tolist(), self.lengths.tolist()):
            yield d if named else None, start, pieces(n)


def write(docs: DataFrame, path: str, folder: str, unit: str = "byte", doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes the texts by the tokenizer file and writes files in ascending order of ids.

    Returns a row a file: part, piece, path, documents, ids; the files' order is that of part and piece.
    """
    if not isinstance(docs.schema[doc].dataType, IntegralType):
        raise TypeError(f"{doc} must be a whole number")
    n = shuffle_partitions(docs.sparkSession)
    ordered = docs.select(F.col(doc).cast("bigint").alias("d"), F.col(text).alias("t")).repartitionByRange(n, "d", F.xxhash64("t")).sortWithinPartitions("d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, piece = TaskContext.get().partitionId(), 0
        encoder, end = json_encoder(path), np.array([END_ID], "<u4")
        coded = ((d, packed) for b in batches for c in text_chunks(b, "t") for d, packed in zip(c.column("d").to_pylist(), encoder.encode(texts_of(c, "t")), strict=True))
        row = next(coded, None)
        while row is not None:
            uri = own_name(f"{folder}/part-{part:06d}-{piece:06d}.idp")
            with new_file(uri) as out:
                writer = Writer(out, unit)
                while row is not None and (not writer.lengths or writer.at < FILE_BYTES and len(writer.lengths) < FILE_DOCUMENTS):
                    writer.add(row[0], np.concatenate([np.frombuffer(row[1], "<u4"), end]))
                    row = next(coded, None)
                total = writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "piece": pa.array([piece], pa.int32()), "path": [uri], "documents": pa.array([len(writer.lengths)], pa.int64()), "ids": pa.array([total], pa.int64())})
            piece += 1

    return ordered.mapInArrow(run, "part int, piece int, path string, documents bigint, ids bigint")


def read(files: DataFrame, doc: str = "doc_id") -> DataFrame:
    """A row a document from the files: id, place of its first id among all, number and crc32 of its ids."""
    spark = files.sparkSession
    before = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)  # a row a file, not a row a document
    placed = files.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with reader(uri) as source:
                    rows: list[tuple] = []
                    for d, start, pieces in Reader(source).documents_in_order():
                        crc = n = 0
                        for p in pieces:
                            crc, n = zlib.crc32(p.tobytes(), crc), n + len(p)
                        rows.append((d, base + start, n, crc))
                        if len(rows) == 20_000:
                            yield _rows(rows, doc)
                            rows = []
                    if rows:
                        yield _rows(rows, doc)

    return placed.repartition(shuffle_partitions(spark)).mapInArrow(run, f"{doc} bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _rows(rows: list[tuple], doc: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[doc, "start", "n_tokens", "ids_crc32"])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, _ = written(write(tables(spark, sf_dir, "documents"), default_tokenizer(), new_folder(spark, "token-planes")), "token-files")
    return read(files)
