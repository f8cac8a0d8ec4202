import math
import random
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm import quality_rules as Q
from tidelog.llm import wordhash as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


EDGES = [None, "", " ", "\n\n", "a", "a\na\n a\na ", "x y z x y z", "Ab\x0bc\x0c d\re", "é é é é", " x y", "a b c\na b c\n\na b c", "#*$ %&|<> #", "a\x1cb a\x1cb"]


def check(texts):
    found = Q.text_counts(pa.array(texts, pa.string()))
    got = list(zip(*(found[k].tolist() for k in Q.COUNTS[:5])))
    assert got == [brute(t) for t in texts]


def test_edges(monkeypatch):
    check(EDGES)
    monkeypatch.setattr(W, "PIECE", 3)
    check(EDGES)
    check(["a b c d " * 400, "line one\n" * 300])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\t#é", max_size=40)), max_size=8))
def test_random(texts):
    check(texts)


def plain_em(patterns, rules, rounds=500, trust=0.85, belief=0.1, least=1e-4):
    """The model's posterior of each pattern of votes, by dictionaries and loops."""
    total = sum(patterns.values())
    often = [{v: sum(n for p, n in patterns.items() if p[j] == v) / total for v in (-1, 0, 1)} for j in range(rules)]

    def scaled(d):
        d = {v: max(least, x) for v, x in d.items()}
        return {v: x / sum(d.values()) for v, x in d.items()}

    def at_first(j, label):
        right, wrong = min(0.99, 2 * trust * often[j][label]), min(0.99, 2 * (1 - trust) * often[j][-label])
        return scaled({label: right, -label: wrong, 0: max(least, 1 - right - wrong)})

    first = {(j, label): at_first(j, label) for j in range(rules) for label in (-1, 1)}
    rate, balance, good = first, 0.5, {}
    for _ in range(rounds):
        for p in patterns:
            weigh = {label: (balance if label == 1 else 1 - balance) * math.prod(rate[j, label][p[j]] for j in range(rules)) for label in (-1, 1)}
            good[p] = weigh[1] / (weigh[1] + weigh[-1])
        share = {label: {p: n * (good[p] if label == 1 else 1 - good[p]) for p, n in patterns.items()} for label in (-1, 1)}
        mass = {label: sum(x.values()) for label, x in share.items()}
        new = {}
        for j, label in first:
            told = {v: sum(x for p, x in share[label].items() if p[j] == v) / mass[label] for v in (-1, 0, 1)}
            new[j, label] = scaled({v: (1 - belief) * told[v] + belief * first[j, label][v] for v in told})
        moved = max(abs(new[k][v] - rate[k][v]) for k in new for v in (-1, 0, 1))
        rate, balance = new, (1 - belief) * mass[1] / total + belief * 0.5
        if moved < 1e-10:
            break
    return {p: 1 / (1 + (1 - balance) / balance * math.prod(rate[j, -1][p[j]] / rate[j, 1][p[j]] for j in range(rules))) for p in patterns}, balance


def coded(votes):
    return sum((v + 1) * 3**k for k, v in enumerate(votes))


def planted(seed, n, balance, chances):
    """chances: of each rule that it votes rightly, and that it votes at all, on bad and on good documents."""
    rng = random.Random(seed)
    counts, said = {}, []
    for _ in range(n):
        good = rng.random() < balance
        votes = tuple((1 if (rng.random() < right) == good else -1) if rng.random() < speaks[good] else 0 for right, speaks in chances)
        counts[votes] = counts.get(votes, 0) + 1
        said.append((good, votes))
    return counts, said


def test_em_finds_the_weak_rule():
    counts, said = planted(5, 20000, 0.6, [(right, (0.7, 0.7)) for right in (0.95, 0.9, 0.85, 0.55)])
    model = Q.fit({coded(v): n for v, n in counts.items()}, 4)
    assert model.accuracy[:3] == pytest.approx([0.95, 0.9, 0.85], abs=0.04) and model.accuracy[3] < 0.65
    told = [(g, v) for g, v in said if any(v[:3])]
    assert sum((model.posterior(v) >= 0.5) == g for g, v in told) / len(told) > 0.9
    assert Q.fit({}, 3).posterior([0, 0, 0]) == 0.5


@pytest.mark.parametrize("balance", [0.15, 0.5, 0.9])
def test_em_finds_the_balance_and_who_abstains(balance):
    chances = [(0.95, (0.6, 0.05)), (0.9, (0.7, 0.1)), (0.92, (0.05, 0.9)), (0.85, (0.5, 0.5))]
    counts, said = planted(7, 30000, balance, chances)
    model = Q.fit({coded(v): n for v, n in counts.items()}, 4, belief=0.01)
    assert model.balance == pytest.approx(balance, abs=0.05)
    for (bad, good), (_, speaks) in zip(model.rates, chances):
        assert 1 - bad[1] == pytest.approx(speaks[0], abs=0.12) and 1 - good[1] == pytest.approx(speaks[1], abs=0.12)
    assert sum((model.posterior(v) >= 0.5) == g for g, v in said) / len(said) > 0.88


def test_em_against_plain_loops():
    for seed, balance in ((1, 0.3), (2, 0.8)):
        counts, _ = planted(seed, 500, balance, [(0.9, (0.5, 0.2)), (0.8, (0.3, 0.6)), (0.7, (0.4, 0.4))])
        model = Q.fit({coded(v): n for v, n in counts.items()}, 3)
        want, share = plain_em(counts, 3)
        assert model.balance == pytest.approx(share, abs=1e-7)
        assert {v: model.posterior(list(v)) for v in counts} == pytest.approx(want, abs=1e-7)


def test_a_tie_keeps(spark):
    """No rule votes, so every posterior is a half."""
    assert Q.fit({coded([0] * len(Q.RULES)): 9}, len(Q.RULES)).posterior([0] * len(Q.RULES)) == 0.5
    text = " ".join(f"word{k}" for k in range(60))  # no stop, so not prose
    docs = spark.createDataFrame([(1, text), (2, text + " x")], "doc_id long, text string")
    assert Q.keep_good(docs).count() == 2
    judged = Q.judge(Q.with_counts(docs)).collect()
    assert [r["posterior"] for r in judged] == [0.5, 0.5] and all(r["kept"] for r in judged)


def test_frame(spark):
    prose = " ".join(f"word{i} and" for i in range(60))
    rows = [(1, prose, "x"), (1, prose, "x"), (2, None, None), (3, "", "y"), (None, "THE!! " * 80, "z"), (5, "a b c " * 40, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 1]
    assert Q.keep_good(docs.limit(0)).count() == 0
    clash = Q.keep_good(docs.withColumnRenamed("n_words", "_Quality_kept"))
    assert clash.columns == ["doc_id", "text", "_Quality_kept"] and clash.count() == 2


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in Q.op9_quality_rules(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        n, chars, symbols, dup, repeat = brute(d["text"])
        g = got[d["doc_id"]]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert g["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        assert g["kept"] == (not g["base_failed"] and g["posterior"] >= 0.5)
