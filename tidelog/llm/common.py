"""What the operators share: the scratch folder, tables read back, sizes, ids."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = LOCAL_CHECKPOINTS
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder name under the shared one, removed when the session's JVM ends."""
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex[:12]}"
    at, fs = _path(spark, path)
    fs.deleteOnExit(at)
    return path


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _path(spark, path)
    fs.delete(at, True)


def written(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """The frame as a Parquet table in the shared folder, and its path.

    Cuts the lineage: a lost executor costs no more than the reading task.
    """
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def broadcast_if_small(df: DataFrame, nbytes: int, limit: int) -> DataFrame:
    """The frame with a broadcast hint if it takes at most ``limit`` bytes, else as it is."""
    return F.broadcast(df) if nbytes <= limit else df


#: Keys of most rows that a look-up broadcasts.
HOT_KEYS = 1000


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], values: list[str], often: str) -> DataFrame:
    """The rows with ``values`` of the table, which has each of the keys once; null where it has none.

    often: a column of the table, in how many rows a key is.  The HOT_KEYS keys
    of most rows are broadcast, and rows that have them go to the shuffle under
    numbers of their own, so that no key, however hot, fills one task.  The
    first key must be a bigint.
    """
    first, *others = keys
    taken = [*rows.columns, *table.columns]
    mark, key = fresh("hot", taken), fresh("key", taken)
    hot_values = {v: fresh(f"hot_{v}", taken) for v in values}
    hot = table.orderBy(F.desc(often)).limit(HOT_KEYS).select(*keys, *[F.col(v).alias(h) for v, h in hot_values.items()], F.lit(True).alias(mark))
    near = rows.join(F.broadcast(hot), keys, "left")
    own = F.xxhash64(F.monotonically_increasing_id())
    near = near.withColumn(key, F.when(F.col(mark), own).otherwise(F.col(first)))
    far = table.select(F.col(first).alias(key), *others, *values)
    found = near.join(far, [key, *others], "left")
    return found.select(*rows.columns, *[F.when(F.col(mark), F.col(hot_values[v])).otherwise(F.col(v)).alias(v) for v in values])


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def map_batches(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, name: str = "text") -> DataFrame:
    """mapInArrow over slices of bounded text size."""
    from tidelog.llm.wordhash import text_chunks, tidy

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch, name):
                out = make(chunk)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(tidy(run), schema)


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *new.values()], names=[*batch.schema.names, *new])


def fresh(name: str, taken: Iterable[str]) -> str:
    """The name, with underscores before it as long as a column has it; Spark tells names apart without case."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def named_rows(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """The frame and its column of unique names: the ids, or where they are null or occur twice numbers of rows in the order of ids."""
    n, named, different = docs.agg(F.count("*"), F.count(doc), F.count_distinct(doc)).first()
    if n == named == different:
        return docs, doc
    row = fresh("row", docs.columns)
    in_order = docs.repartitionByRange(shuffle_partitions(docs.sparkSession), doc, F.xxhash64(text)).sortWithinPartitions(doc)
    return written(in_order.withColumn(row, F.monotonically_increasing_id()), "numbered")[0], row
