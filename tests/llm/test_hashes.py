"""Texts of a regular build, that clash under polynomials modulo a power of two."""

import numpy as np
import pyarrow as pa
import pytest

from tidelog.llm import decontaminate, ngram_join, quality_rules
from tidelog.llm import repeated_passages as R
from tidelog.llm import wordhash as W

SWAP = str.maketrans("ab", "ba")


def regular(n):
    return "".join("ab"[k.bit_count() & 1] for k in range(n))


SIZES = (64, 255, 256, 257, 1024, 2048, 1 << 14)


@pytest.mark.parametrize("n", SIZES)
def test_words_and_lines_differ(n):
    texts = [regular(n), regular(n).translate(SWAP)]
    column = pa.array(texts)
    raw, offsets = W.utf8_buffer(column)
    words, starts, _ = W.word_hashes(raw, offsets)
    lines, *_ = W.line_hashes(raw, offsets, starts)
    assert len(set(words.tolist())) == len(set(lines.tolist())) == 2
    one_text = pa.array(["\n".join(texts)])
    assert quality_rules.text_counts(one_text)["n_dup_lines"].tolist() == [0]


def test_a_word_is_alike_wherever_it_stands(monkeypatch):
    words = [regular(700), regular(300), "x", "é" * 200]
    texts = [" ".join(words), "  \n" + "\t".join(reversed(words)) + " ", *(w.upper().replace("É", "é") for w in words)]
    want = {}
    for piece in (W.PIECE, 5, 257, 1000):
        monkeypatch.setattr(W, "PIECE", piece)
        h, _, first = W.word_hashes(*W.utf8_buffer(pa.array(texts)))
        own = h[first[0] : first[1]].tolist()
        assert h[first[1] : first[2]].tolist() == own[::-1] and h[first[2] :].tolist() == own
        assert want.setdefault("h", own) == own


def test_runs_of_words_differ():
    words = np.array([W.mix(np.array([k], np.uint64))[0] for k in (1, 2)])
    for n in (3, 5):
        rows = [[k >> j & 1 for j in range(n)] for k in range(1 << n)]
        assert len({int(W.window_hashes(words[r], n)[0]) for r in rows}) == 1 << n


def test_documents_differ(spark):
    a, b = regular(1024), regular(1024).translate(SWAP)
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    assert sorted(tuple(r) for r in ngram_join.jaccard_components(docs).collect()) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]
    leaks = decontaminate.leaks(docs, spark.createDataFrame([(7, a)], "item_id long, text string"))
    assert sorted(r["doc_id"] for r in leaks.collect()) == [1, 3]


def test_phrases_differ():
    raw = np.frombuffer((regular(1 << 12) + regular(1 << 12).translate(SWAP)).encode(), np.uint8)
    starts = np.array([0, 1 << 12])
    assert len(set(R._fingerprints(raw, starts, starts + (1 << 12)).tolist())) == 2
    # one window twice, its mirror once
    text = regular(100) + regular(100).translate(SWAP) + regular(100)
    ranks = R.suffix_ranks(np.frombuffer(text.encode(), np.uint8), 100)
    assert ranks[0] == ranks[200] != ranks[100]


def test_ranks_are_those_of_sorted_suffixes():
    rng = np.random.default_rng(3)
    for length in (1, 3, 8, 13, 100):
        raw = rng.integers(97, 99, 400, dtype=np.uint8)
        raw[200:] = raw[:200]
        own = [raw[k : k + length].tobytes() for k in range(len(raw) - length + 1)]
        place = {s: k for k, s in enumerate(sorted(set(own)))}
        assert R.suffix_ranks(raw, length).tolist() == [place[s] for s in own]
