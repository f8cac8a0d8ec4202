import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidelog.llm import bpe

PATH, PATTERN = bpe.multilingual()
JSON = P.path("byte_bpe_50k.json")
UNTOUCHED = Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def ids(encoder, text):
    return np.frombuffer(next(encoder.encode([text])), "<u4").tolist()


ODD = ["", " ", "a  b", "x\n\n y", "it's we'll 'S", "naïve café 12½", "日本語 テキスト", "👩‍👩‍👧 z", "a b c", "a\x1cb\x1fc\x85d", "١٢٣ ⅷ x²", "aaaaaaaaaaaa", "abababababab", "\t\r\n", "<|endoftext|> x", "ée", "_a__b_", "​﻿", "----====----", "x" * 500]


@pytest.mark.parametrize("text", ODD)
def test_as_the_library(library, text):
    encoder = bpe.ranks_encoder(PATH, PATTERN)
    assert ids(encoder, text) == library.encode_ordinary(text)
    assert encoder.decode(ids(encoder, text)) == text.encode()


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab '\n\té1.", max_size=60)))
def test_random_texts(library, text):
    encoder = bpe.ranks_encoder(PATH, PATTERN)
    assert ids(encoder, text) == library.encode_ordinary(text)


def test_many_words(library):
    encoder = bpe.ranks_encoder(PATH, PATTERN)
    rng = random.Random(3)
    for alphabet in ("ab", "abc", "aeinrst", "éèàabc", "01", "aeiouñlmnrst"):
        for _ in range(1500):
            word = "".join(rng.choices(alphabet, k=rng.randint(1, 14)))
            assert ids(encoder, word) == library.encode_ordinary(word), word


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_json_file_split_or_whole(text):
    encoder = bpe.json_encoder(JSON)
    whole = UNTOUCHED.encode(text, add_special_tokens=False).ids
    assert ids(encoder, text) == whole


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>é", "<|endoftext", "日本<|endoftext|>"])
def test_special_strings(text, library):
    encoder = bpe.json_encoder(JSON)
    assert ids(encoder, text) == UNTOUCHED.encode(text, add_special_tokens=False).ids
    assert ids(bpe.ranks_encoder(PATH, PATTERN), text) == library.encode_ordinary(text)


@pytest.mark.parametrize("pattern", [r"\p{L}+|\p{N}{1,3}|[^\p{L}\p{N}]", r"\S+|\s+", r"[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"])
def test_other_patterns(pattern):
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    encoder = bpe.ranks_encoder(PATH, pattern)
    for text in [*ODD, "The year 20245, it's (really) fine.\n\n  Next\tline!"]:
        assert ids(encoder, text) == own.encode_ordinary(text)


def test_another_pre_tokenizer(tmp_path):
    import json

    from tokenizers import pre_tokenizers

    t = Tokenizer.from_file(JSON)
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Digits(individual_digits=True), pre_tokenizers.ByteLevel(add_prefix_space=False)])
    path = str(tmp_path / "t.json")
    t.save(path)
    assert json.loads(open(path).read())["pre_tokenizer"]["type"] == "Sequence"
    for text in ("it is 2024 now", "1234567", "a  b 99"):
        assert ids(bpe.json_encoder(path), text) == t.encode(text, add_special_tokens=False).ids


def test_small_cache(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    encoder = bpe.ranks_encoder(PATH, PATTERN)
    encoder.known.clear()
    for text in ("one two three four five six", "seven two one " * 20):
        assert ids(encoder, text) == library.encode_ordinary(text)


def test_offsets():
    encoder = bpe.ranks_encoder(PATH, PATTERN)
    text = "naïve 👩 日本 x"
    found = ids(encoder, text)
    starts, ends = bpe.offsets(encoder.table, found)
    assert starts[0] == 0 and ends[-1] == len(text)
    for k, s, e in zip(found, starts, ends):
        piece = encoder.table[k]
        assert piece in text[s:e].encode() or s < e
        if all((b & 0xC0) != 0x80 for b in piece):
            assert text[s:e].encode() == piece


def test_frames(spark, library):
    rows = [(1, "some text", "k"), (1, "some text", "k"), (2, None, None), (None, "", "k"), (3, "日本 " * 60_000, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.digests(docs, PATH, PATTERN).collect()
    for r, (i, text, _) in zip(got, rows):
        want = library.encode_ordinary(text or "")
        assert r["doc_id"] == i and r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    clash = docs.selectExpr("doc_id", "text", "ids", "'s' as starts", "1 as ends", "2 as data")
    back = bpe.decode_frame(bpe.encode_frame(clash, PATH, PATTERN), PATH, PATTERN)
    assert back.columns == ["doc_id", "starts", "ends", "data"]
    back = back.collect()
    assert [bytes(r["data"]).decode() for r in back if "data" in r] == [t or "" for _, t, _ in rows]
    assert bpe.digests(docs.limit(0), PATH, PATTERN).count() == 0


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = bpe.op8_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        want = library.encode_ordinary(texts[r["doc_id"]])
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
