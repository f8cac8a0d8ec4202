"""WARC archives: writing pages with one response a payload, and a reader that salvages.

Every page is a record; of pages with equal payloads that with the largest
page_id is the response and the others are revisits of it.  Records are gzip
members of their own, in archives of bounded size.

The reader checks each record: the member's checksum, the version line, the
headers and their checksum where they have one, the length, the end and the
digests of block and payload.  That a
record ends where its length says is looked up at that place before what lies
between is read, so a damaged length costs no memory.  After a failed check it
searches, to the end of the archive if need be, for the next gzip member that
begins a record or the next version line, whichever comes first, goes on from
there, and logs the bytes passed over as a row of the same frame as the
records.  Whether a record is packed is told at
its place, so what is damaged elsewhere has no say in it.  A record that is
quoted whole within a damaged one counts as a record.

Null html counts as empty.  Rows tied for the largest page_id are all
responses; a null page_id is below all others, and if a payload has no other
they are all responses.  An empty table writes no archives and gives no rows;
other columns are ignored, whatever their names.  A record is held in memory,
whatever its size, an archive is not.
"""

from __future__ import annotations

import base64
import hashlib
import logging
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import suppress
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import new_folder, shuffle_partitions, tables, written
from tidelog.llm.storage import new_file, own_name, reader
from tidelog.llm.wordhash import text_chunks

VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
ARCHIVE_BYTES = 64 << 20
#: Payloads below this size are never revisited.
REVISIT_FROM = 0
BROADCAST_BYTES = 16 << 20
READ = 1 << 18
#: Payloads looked up by broadcast however large the table of payloads is: those of most pages.
HOT_PAYLOADS = 1000
#: The last header of a record written here: the crc32 of all lines before it.
HEAD_CHECK = "X-Header-CRC32"
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MEMBER = b"\x1f\x8b\x08"
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.\d+\r\n")
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id} {url}')}>"


def _safe(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")


def _sha1(data) -> str:
    return f"sha1:{digest(data)}"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False, refers_to_url: str | None = None) -> bytes:
    """A whole record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        VERSION.decode(),
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, url or '')}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_safe(url)}",
        f"WARC-Block-Digest: {_sha1(block)}",
        f"WARC-Payload-Digest: {_sha1(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += [
            f"WARC-Profile: {REVISIT_PROFILE}",
            f"WARC-Refers-To: {record_id(refers_to, refers_to_url or '')}",
            f"WARC-Refers-To-Target-URI: {_safe(refers_to_url)}",
            f"WARC-Refers-To-Date: {DATE}",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    head = "\r\n".join([*lines, ""]).encode()
    return head + f"{HEAD_CHECK}: {zlib.crc32(head):08x}".encode() + END + block + END


def packed(raw: bytes, level: int = 4) -> bytes:
    press = zlib.compressobj(level, zlib.DEFLATED, 31)
    return press.compress(raw) + press.flush()


class Broken(ValueError):
    """A record that fails a check."""


@dataclass
class Record:
    """at: the first byte in the archive. length: its bytes there."""

    at: int
    length: int
    headers: dict[str, str]
    payload: bytes


@dataclass
class Gap:
    """Bytes from start to before end that gave no record."""

    start: int
    end: int
    reason: str


def _head(line: Callable[[int], tuple[bytes, int]]) -> tuple[dict[str, str], int, int]:
    """(headers, first byte of the block, byte after it), told line by line; a line that can't be one ends it."""
    first, at = line(0)
    if not re.fullmatch(rb"WARC/1\.\d+", first):
        raise Broken("no version line")
    headers, check = {}, zlib.crc32(first + b"\r\n")
    while True:
        told, at = line(at)
        if not told:
            break
        name, colon, value = told.partition(b":")
        if not colon:
            raise Broken("a header without a colon")
        if name.decode("latin-1") == HEAD_CHECK and value.strip() != b"%08x" % check:
            raise Broken("the headers' checksum differs")
        check = zlib.crc32(told + b"\r\n", check)
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", length):
        raise Broken("no content length")
    return headers, at, at + int(length)


def _payload(headers: dict[str, str], raw: bytes | bytearray, start: int, end: int) -> bytes:
    """The payload of the block from start to end, its digests being checked."""
    with memoryview(raw) as view:
        block = view[start:end]
        told = headers.get("warc-block-digest", "")
        if told.startswith("sha1:") and told != _sha1(block):
            block.release()
            raise Broken("digest of the block differs")
        http = raw.find(END, start, end) if headers.get("content-type", "").startswith("application/http") else -1
        payload = bytes(view[http + len(END) : end] if http >= 0 else block)
        block.release()
    told = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") == "response" and told.startswith("sha1:") and told != _sha1(payload):
        raise Broken("digest differs")
    return payload


@dataclass
class Salvage:
    """Iterates over an archive's records; gaps has what was passed over so far."""

    source: pa.NativeFile
    gaps: list[Gap] = field(default_factory=list)
    base: int = 0
    buffer: bytearray = field(default_factory=bytearray)
    ended: bool = False

    def _more(self) -> bool:
        got = b"" if self.ended else self.source.read(READ)
        self.ended = self.ended or not got
        self.buffer += got
        return bool(got)

    def _drop(self, n: int) -> None:
        del self.buffer[:n]
        self.base += n

    def __iter__(self) -> Iterator[Record]:
        while self.buffer or self._more():
            while len(self.buffer) < len(MEMBER) and self._more():
                pass
            try:
                used, headers, payload = self._member() if self.buffer.startswith(MEMBER) else self._plain()
            except Broken as why:
                self._resume(str(why))
                continue
            yield Record(self.base, used, headers, payload)
            self._drop(used)

    def _pieces(self, at: int) -> Iterator[tuple[bytes, int]]:
        """What the member at a place in the buffer unpacks to, and where it ends in the buffer as far as is known."""
        unzip = zlib.decompressobj(31)
        while not unzip.eof:
            if at == len(self.buffer) and not self._more():
                raise Broken("cut short")
            chunk = bytes(self.buffer[at : at + READ])
            at += len(chunk)
            try:
                while True:
                    out = unzip.decompress(chunk, READ)
                    chunk = unzip.unconsumed_tail
                    yield out, at - len(unzip.unused_data)
                    if unzip.eof or not (chunk or len(out) == READ):
                        break
            except zlib.error as why:
                raise Broken("damaged member") from why

    def _member(self) -> tuple[int, dict[str, str], bytes]:
        raw, used, told = bytearray(), 0, None

        def line(at: int) -> tuple[bytes, int]:
            end = raw.find(b"\r\n", at)
            if end < 0:
                raise EOFError
            return bytes(raw[at:end]), end + 2

        for out, used in self._pieces(0):
            raw += out
            if told is None:
                with suppress(EOFError):
                    told = _head(line)
            if told and len(raw) > told[2] + len(END):
                raise Broken("more than a record")
        if not told or len(raw) < told[2] + len(END):
            raise Broken("cut short")
        headers, start, end = told
        if raw[end:] != END:
            raise Broken("no end of record")
        return used, headers, _payload(headers, raw, start, end)

    def _line(self, at: int) -> tuple[bytes, int]:
        """The line at a place in the buffer, and the place after it; what has no line end soon must at least begin as a record."""
        seen = at
        while (end := self.buffer.find(b"\r\n", seen)) < 0:
            if at == 0 and len(self.buffer) > 64:
                raise Broken("no version line")
            seen = max(at, len(self.buffer) - 1)
            if not self._more():
                raise Broken("cut short")
        return bytes(self.buffer[at:end]), end + 2

    def _at(self, place: int, n: int) -> bytes:
        """n bytes at a place counted from the buffer's start, read from there alone if they are further on."""
        if place + n <= len(self.buffer):
            return bytes(self.buffer[place : place + n])
        if not self.source.seekable():
            while len(self.buffer) < place + n and self._more():
                pass
            return bytes(self.buffer[place : place + n])
        here = self.source.tell()
        if self.base + place + n > self.source.size():
            return b""
        self.source.seek(self.base + place)
        found = self.source.read(n)
        self.source.seek(here)
        return found

    def _plain(self) -> tuple[int, dict[str, str], bytes]:
        headers, start, end = _head(self._line)
        found = self._at(end, len(END))
        if found != END:
            raise Broken("no end of record" if len(found) == len(END) else "cut short")
        while len(self.buffer) < end + len(END) and self._more():
            pass
        return end + len(END), headers, _payload(headers, self.buffer, start, end)

    def _begins_record(self, at: int) -> bool:
        """Whether what was found at a place in the buffer is a version line, or a member that begins with one."""
        if not self.buffer.startswith(MEMBER, at):
            return True
        try:
            begun = b""
            for out, _ in self._pieces(at):
                begun += out
                if len(begun) >= 5:
                    break
            return begun[:5] == b"WARC/"
        except Broken:
            return False

    def _resume(self, reason: str) -> None:
        """Moves to the next place that begins a record, packed or plain, and logs the gap."""
        start, at, keep = self.base, 1, 16
        while True:
            found = _START.search(self.buffer, at)
            if found:
                at = found.start()
                if self._begins_record(at):
                    break
                at += 1
                continue
            drop = max(0, len(self.buffer) - keep)
            self._drop(drop)
            at = 0 if drop else 1
            if not self._more():
                at = len(self.buffer)
                break
        self._drop(at)
        if self.gaps and self.gaps[-1].end == start:
            self.gaps[-1].end = self.base
        else:
            self.gaps.append(Gap(start, self.base, reason))


def classified(pages: DataFrame, revisit_from: int = REVISIT_FROM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, payload, and response_id and response_url of the largest page_id with that payload where it may be revisited.

    Payloads that occur once need no join: only those of several pages are
    looked up.  A small table of them is broadcast.  Of a larger one those of
    most pages are, and the pages that have them don't take part in the
    shuffle by payload.
    """
    spark = pages.sparkSession
    own = pages.select("page_id", "url", F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8").alias("payload"))
    size, sha = F.octet_length("payload"), F.sha1("payload")
    own = own.withColumn("key", F.when(size >= revisit_from, F.concat_ws(" ", sha, size.cast("string"))))
    told = own.filter("key is not null").groupBy("key").agg(F.max(F.struct("page_id", "url")).alias("response"), F.count("*").alias("pages"))
    several, _ = written(told.filter("pages > 1"), "warc-payloads")
    several = several.select("key", F.col("response.page_id").alias("response_id"), F.col("response.url").alias("response_url"), "pages")
    out = ("page_id", "url", "payload", "response_id", "response_url")
    rows, urls = several.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("response_url")), F.lit(0))).first()
    if 200 * rows + urls <= broadcast_bytes:
        return own.join(F.broadcast(several), "key", "left").select(*out)
    hot = several.orderBy(F.desc("pages")).limit(HOT_PAYLOADS)
    hot = hot.select("key", F.col("response_id").alias("hot_id"), F.col("response_url").alias("hot_url"))
    near = own.join(F.broadcast(hot), "key", "left")
    apart = F.when(F.col("hot_id").isNull() & F.col("key").isNotNull(), F.col("key")).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")))
    far = several.select(F.col("key").alias("far_key"), "response_id", "response_url")
    joined = near.withColumn("far_key", apart).join(far, "far_key", "left")
    return joined.select("page_id", "url", "payload", F.coalesce("hot_id", "response_id").alias("response_id"), F.when(F.col("hot_id").isNotNull(), F.col("hot_url")).otherwise(F.col("response_url")).alias("response_url"))


def is_revisit() -> Column:
    return F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))


def write(pages: DataFrame, folder: str, revisit_from: int = REVISIT_FROM, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives; a row an archive: path, records."""
    rows = classified(pages, revisit_from, BROADCAST_BYTES).withColumn("revisit", is_revisit())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        rows = (r for b in batches for c in text_chunks(b, "payload") for r in c.to_pylist())
        row = next(rows, None)
        while row is not None:
            uri, size, n = own_name(f"{folder}/pages-{part:06d}-{made:04d}.warc.gz"), 0, 0
            with new_file(uri) as out:
                while row is not None and (not n or size < archive_bytes):
                    raw = packed(record(row["page_id"], row["url"], row["payload"], row["response_id"], row["revisit"], row["response_url"]))
                    out.write(raw)
                    size, n = size + len(raw), n + 1
                    row = next(rows, None)
            made += 1
            yield pa.RecordBatch.from_pydict({"path": [uri], "records": pa.array([n], pa.int64())})

    return rows.mapInArrow(run, "path string, records bigint")


_READ = {
    "page_id": pa.int64(),
    "payload_bytes": pa.int64(),
    "payload_digest": pa.string(),
    "record_type": pa.string(),
    "refers_to": pa.int64(),
    "url": pa.string(),
    "path": pa.string(),
    "at": pa.int64(),
    "payload": pa.binary(),
    "gap_end": pa.int64(),
    "reason": pa.string(),
}
_READ_DDL = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, path string, at bigint, payload binary, gap_end bigint, reason string"


def salvaged(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives named in column path, and a row for each gap: path, at, gap_end and reason, the rest null.

    Without ``payloads`` those are null, too; they are checked all the same.
    """

    def rows(uri: str) -> Iterator[tuple]:
        with reader(uri) as source:
            salvage, told = Salvage(source), 0
            for r in salvage:
                h = r.headers
                kind, page, to = h.get("warc-type", ""), h.get("x-page-id"), h.get("x-refers-to-page-id")
                full = int(h["x-payload-length"]) if kind == "revisit" and h.get("x-payload-length", "").isdigit() else len(r.payload)
                yield (int(page) if page else None, full, h.get("warc-payload-digest", "").removeprefix("sha1:"), kind, int(to) if to and to != "None" else None, h.get("warc-target-uri"), uri, r.at, r.payload if payloads else None, None, None)
            for g in salvage.gaps:
                yield (None, None, None, None, None, None, uri, g.start, None, g.end, g.reason)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _READ.values(), strict=True)], names=list(_READ))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                held, size = [], 0
                for row in rows(uri):
                    held.append(row)
                    size += len(row[8] or b"")
                    if size > 4 << 20 or len(held) == 5000:
                        yield batch_of(held)
                        held, size = [], 0
                if held:
                    yield batch_of(held)

    return archives.select("path").repartition(shuffle_partitions(archives.sparkSession)).mapInArrow(run, _READ_DDL)


def records_of(found: DataFrame) -> DataFrame:
    return found.filter("gap_end is null").drop("gap_end", "reason")


def gaps_of(found: DataFrame) -> DataFrame:
    """path, start, end and reason of the bytes passed over."""
    return found.filter("gap_end is not null").select("path", F.col("at").alias("start"), F.col("gap_end").alias("end"), "reason")


def read(archives: DataFrame, gaps: bool = False) -> DataFrame:
    """The records of the archives named in column path; with ``gaps`` the bytes passed over instead."""
    return gaps_of(salvaged(archives, False)) if gaps else records_of(salvaged(archives))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives, _ = written(write(tables(spark, sf_dir, "pages"), new_folder(spark, "warc")), "warc-archives")
    found, _ = written(salvaged(archives, False).drop("payload"), "warc-records")
    lost = gaps_of(found).agg(F.count("*"), F.sum(F.col("end") - F.col("start"))).first()
    if lost[0]:
        logging.getLogger(__name__).warning("%d gaps of %d bytes in the archives", *lost)
    return records_of(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def base32_sql(hex_digest: str) -> str:
    """DuckDB SQL for the base32 form of a 40-digit hexadecimal expression."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digits = [f"substr('{alphabet}', 1 + (((('0x' || substr({hex_digest}, {k // 8 * 10 + 1}, 10))::BIGINT) >> {35 - k % 8 * 5}) & 31)::INTEGER, 1)" for k in range(32)]
    return " || ".join(digits)


OP4_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS response_id FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {base32_sql("hex")} AS payload_digest,
       CASE WHEN page_id = response_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response_id THEN response_id END AS refers_to
FROM d
"""
