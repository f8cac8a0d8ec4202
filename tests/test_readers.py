import pytest

from tidelog.schemas import RAW_EVENT
from tidelog.sources import readers as R


@pytest.fixture
def files(spark, tmp_path):
    """Six files of raw events, of three kinds, some with fewer columns; a name with a blank."""
    base = spark.range(5).selectExpr("id as pos", "timestamp_ntz'2024-01-01 00:00:00' as ts", "'XIDEvent' as event_type", "id * 2 as row_count")
    paths = []
    for k, kind in enumerate(["parquet", "json", "parquet", "csv", "json", "csv"]):
        folder, path = tmp_path / f"d{k}", tmp_path / f"log {k}.{kind}"
        own = base.withColumn("schema", R.F.lit(f"s{k}"))
        own = own if kind == "csv" else own.drop("row_count") if k % 2 else own
        if kind == "csv":
            own = own.select(*[R.F.col(f.name).cast(f.dataType) if f.name in own.columns else R.F.lit(None).cast(f.dataType).alias(f.name) for f in RAW_EVENT])
        getattr(own.coalesce(1).write.option("header", "true"), kind)(str(folder))
        next(folder.glob("part-*")).rename(path)
        paths.append(str(path))
    return paths


def test_many_files_are_read_as_few(spark, files, monkeypatch):
    want = sorted(map(tuple, R.FileSource(files).load(spark).collect()))
    assert [r[1] for r in want] == [k * R.FILE_SPAN + p for k in range(6) for p in range(5)]
    monkeypatch.setattr(R, "MANY_FILES", 2)
    monkeypatch.setattr(R.FileSource, "_one", None)
    got = R.FileSource(files).load(spark)
    assert got.schema.names == RAW_EVENT.names
    assert sorted(map(tuple, got.collect())) == want


def test_a_file_twice_and_folders_are_read_one_by_one(spark, files, monkeypatch, tmp_path):
    monkeypatch.setattr(R, "MANY_FILES", 2)
    twice = [files[0], files[0], files[2]]
    assert R.FileSource(twice).load(spark).groupBy("file_idx").count().count() == 3
    folder = str(tmp_path / "folder.parquet")
    spark.read.parquet(files[0]).write.parquet(folder)
    assert R.FileSource([folder, files[2]]).load(spark).count() == 10
    with pytest.raises(ValueError):
        R.FileSource([]).load(spark)
