"""Raw change events from files, in one total order."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from typing import Protocol
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.schemas import RAW_EVENT

#: Places of a file in the total order; a file may not be longer.
FILE_SPAN = 1 << 44


class RawEventSource(Protocol):
    """Anything that gives raw events."""

    def load(self, spark: SparkSession) -> DataFrame: ...


def check_files(paths: Sequence[str]) -> None:
    """Local files must exist; what other stores hold is for their readers to say."""
    for path in paths:
        parts = urlparse(path)
        if parts.scheme in ("", "file") and not os.path.exists(parts.path):
            raise FileNotFoundError(f"file not found: {path}")


def _numbered(frame: DataFrame, number: int) -> DataFrame:
    """A file's events as RAW_EVENT; seq orders by file, then by the file's own seq or else pos."""
    own = [F.col(c) for c in ("seq", "pos") if c in frame.columns]
    if not own:
        raise ValueError("a file of raw events needs a column seq or pos")
    named = frame.withColumns({"file_idx": F.lit(number), "seq": (F.coalesce(*own).cast("bigint") + F.lit(number * FILE_SPAN))})
    return named.select(*[(F.col(f"`{f.name}`") if f.name in named.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW_EVENT.fields])


def in_file_order(frames: Sequence[DataFrame]) -> DataFrame:
    """The union of files in the order given."""
    parts = [_numbered(frame, k) for k, frame in enumerate(frames)]
    if not parts:
        raise ValueError("no files")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: From so many files of a kind on, they are read as one table.
MANY_FILES = 32


def _same_root(uri: str) -> str:
    """Local files are named with one slash or three."""
    return re.sub("^file:/+", "file:/", uri)


def _kind(path: str) -> str:
    ending = path.rstrip("/").rpartition(".")[2].lower()
    return {"parquet": "parquet", "json": "json", "jsonl": "json", "ndjson": "json", "csv": "csv"}.get(ending, "binlog")


class FileSource:
    """Files of raw events: Parquet, JSON lines, CSV with a header, or binary logs; the kind goes by the ending."""

    def __init__(self, paths: Sequence[str]):
        self.paths = list(paths)

    def load(self, spark: SparkSession) -> DataFrame:
        """Few files are read one by one, each with the columns it has.

        Of many files of one kind, none of them a folder or named twice, one
        table is read and a file's number joined to its rows, so the plan does
        not grow with them; they must have the types of RAW_EVENT, but may
        lack columns.
        """
        check_files(self.paths)
        kinds: dict[str, list[int]] = {}
        for k, path in enumerate(self.paths):
            kinds.setdefault(_kind(path), []).append(k)
        parts, alone = [], set(range(len(self.paths)))
        for kind, numbers in kinds.items():
            if kind != "binlog" and len(numbers) >= MANY_FILES:
                found = self._together(spark, kind, numbers)
                if found is not None:
                    parts.append(found)
                    alone -= set(numbers)
        parts += [_numbered(self._one(spark, self.paths[k]), k) for k in sorted(alone)]
        if not parts:
            raise ValueError("no files")
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _together(self, spark: SparkSession, kind: str, numbers: list[int]) -> DataFrame | None:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        names: dict[str, int] = {}
        for k in numbers:
            at = jvm.org.apache.hadoop.fs.Path(self.paths[k])
            fs = at.getFileSystem(conf)
            names[_same_root(fs.makeQualified(at).toUri().toString())] = k
            if fs.getFileStatus(at).isDirectory():
                return None
        if len(names) < len(numbers):
            return None
        reader = spark.read.schema(RAW_EVENT)
        paths = [self.paths[k] for k in numbers]
        read = reader.csv(paths, header=True, enforceSchema=False) if kind == "csv" else getattr(reader, kind)(paths) if kind == "json" else reader.parquet(*paths)
        index = spark.createDataFrame(list(names.items()), "file string, number int")
        file = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")
        own = read.withColumn("file", file).join(index, "file", "left")
        number = F.coalesce("number", F.raise_error(F.concat(F.lit("a file that was not asked for: "), F.col("file"))).cast("int"))
        own = own.withColumn("file_idx", number)
        return own.withColumn("seq", F.coalesce("seq", "pos") + F.col("file_idx").cast("bigint") * FILE_SPAN).select(*RAW_EVENT.names)

    @staticmethod
    def _one(spark: SparkSession, path: str) -> DataFrame:
        kind = _kind(path)
        if kind == "parquet":
            return spark.read.parquet(path)
        if kind == "json":
            return spark.read.schema(RAW_EVENT).json(path)
        if kind == "csv":
            return spark.read.schema(RAW_EVENT).csv(path, header=True, enforceSchema=False)
        from tidelog.sources.binlog import read_binlog

        return read_binlog(spark, path)
