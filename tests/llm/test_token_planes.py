import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidelog.llm import token_planes as T
from tidelog.llm.common import written
from tidelog.llm.storage import new_file, own_name, reader


@pytest.mark.parametrize("unit", ["bit", "byte"])
def test_planes_round_trip(unit):
    rng = np.random.default_rng(4)
    for n in (0, 1, 7, 8, 9, 1000):
        for top in (0, 1, 255, 256, 50256, 2**32 - 1):
            ids = rng.integers(0, top + 1, n, dtype=np.uint64).astype("<u4")
            planes = T.to_planes(ids, unit)
            assert (T.from_planes(planes, n, unit) == ids).all()
            if n and top == 255:
                assert len(planes) <= (8 if unit == "bit" else 1)


@pytest.mark.parametrize("unit", ["bit", "byte"])
def test_file(tmp_path, unit):
    rng = np.random.default_rng(4)
    docs = [(k if k % 3 else None, rng.integers(0, 60_000, int(m), dtype=np.uint32)) for k, m in enumerate([0, 5, 64, 1000, 1, 0, 63, 300])]
    uri = f"file://{tmp_path}/a/b.idp"
    with new_file(uri) as out:
        w = T.Writer(out, unit, block=64)
        for d, ids in docs:
            w.add(d, ids)
        assert w.close() == sum(len(i) for _, i in docs)
    every = np.concatenate([i for _, i in docs])
    with reader(uri) as source:
        r = T.Reader(source)
        got = [(d, s, np.concatenate([np.zeros(0, "<u4"), *p])) for d, s, p in r.documents_in_order()]
        assert [g[0] for g in got] == [d for d, _ in docs]
        assert all((g[2] == i).all() for g, (_, i) in zip(got, docs))
        assert [g[1] for g in got] == np.concatenate([[0], np.cumsum([len(i) for _, i in docs])])[:-1].tolist()
        for a, b in [(0, 0), (0, 1), (60, 70), (64, 128), (100, len(every)), (len(every), len(every))]:
            assert (r.ids(a, b) == every[a:b]).all()
        assert (r.chunk(1) == every[64:128]).all()


def test_broken_file_is_refused(tmp_path):
    uri = f"{tmp_path}/b.idp"
    with new_file(uri) as out:
        w = T.Writer(out)
        w.add(1, np.arange(5, dtype="<u4"))
        w.close()
    raw = bytearray(open(uri, "rb").read())
    raw[-30] ^= 1
    with pytest.raises(ValueError):
        T.Reader(pa.BufferReader(bytes(raw)))


def want(rows):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    out, at = [], 0
    for d, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("unit", ["bit", "byte"])
def test_frames(spark, tmp_path, unit):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices(["the", "naïve", "x1", "<|endoftext|>", "日本"], k=k))) for k in range(40)]
    rows += [(40, None), (41, ""), (42, "long text " * 90_000)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    docs = spark.createDataFrame([(d, t, "s") for d, t in shuffled], "doc_id long, text string, start string").repartition(5)
    files, _ = written(T.write(docs, P.path("byte_bpe_50k.json"), f"file://{tmp_path}/{unit}", unit), "t")
    assert sorted(tuple(r) for r in T.read(files).collect()) == want(rows)
    twice, _ = written(T.write(docs.union(docs).union(spark.createDataFrame([(None, "a", "s")] * 2, docs.schema)), P.path("byte_bpe_50k.json"), f"file://{tmp_path}/{unit}2", unit), "t")
    got = T.read(twice).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, *(d for d, _ in rows for _ in range(2))]
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    with pytest.raises(TypeError):
        T.write(docs.withColumn("doc_id", docs.doc_id.cast("string")), P.path("byte_bpe_50k.json"), "unused")
    none, _ = written(T.write(docs.limit(0), P.path("byte_bpe_50k.json"), f"file://{tmp_path}/{unit}0", unit), "t")
    assert T.read(none).count() == 0


@pytest.mark.parametrize("limit", ["FILE_BYTES", "FILE_DOCUMENTS"])
def test_files_end_at_their_size(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(T, limit, 5)
    rows = [(k, "some words " * (k % 7)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    files, _ = written(T.write(docs, P.path("byte_bpe_50k.json"), f"file://{tmp_path}/f"), "t")
    assert files.count() > 10 and files.agg({"documents": "max"}).first()[0] <= (60 if limit == "FILE_BYTES" else 5)
    assert sorted(tuple(r) for r in T.read(files).collect()) == want(rows)


def test_a_file_that_fails_leaves_nothing(tmp_path):
    with pytest.raises(RuntimeError), new_file(f"{tmp_path}/x/y.idp") as out:
        out.write(b"half")
        raise RuntimeError
    assert list((tmp_path / "x").iterdir()) == []
    names = {own_name("s3://b/c.d/part-1.warc.gz") for _ in range(3)}
    assert len(names) == 3 and all(n.startswith("s3://b/c.d/part-1-") and n.endswith(".warc.gz") for n in names)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(tuple(r) for r in T.op5_token_planes(spark, sf).collect()) == want(rows)
