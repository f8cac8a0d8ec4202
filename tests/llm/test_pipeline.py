import hashlib

import tiktoken

import corpus_pipeline
from tests.llm import test_decontaminate, test_ngram_join, test_quality_rules
from tidelog.llm import bpe, pii, quality_rules

SF = "/root/testdata/sf0.001"


def counted(text):
    """The rules' counts by plain code."""
    n, chars, symbols, dup, repeat = test_quality_rules.brute(text)
    text = text or ""
    upper = sum("A" <= c <= "Z" for c in text)
    return {
        "n_words": n,
        "word_chars": chars,
        "n_symbols": symbols,
        "n_dup_lines": dup,
        "n_repeat_words": repeat,
        "n_lines": sum(bool(test_quality_rules.WORD.search(line)) for line in text.split("\n")),
        "n_upper": upper,
        "n_letters": upper + sum("a" <= c <= "z" for c in text),
        "n_shouts": text.count("!"),
        "n_stops": text.count("."),
    }


def judged(rows):
    """The quality stage by plain code: counts and votes row by row, the label model from all of them."""
    counts = [counted(r["text"]) for r in rows]

    def vote(rule, c):
        return rule.says if all(c[b] and lo <= c[t] / c[b] <= hi for t, b, lo, hi in rule.tests) else 0

    votes = [tuple(vote(rule, c) for rule in quality_rules.RULES) for c in counts]
    patterns = {v: votes.count(v) for v in set(votes)}
    good, _ = test_quality_rules.plain_em(patterns, len(quality_rules.RULES))
    passed = [c["n_words"] >= 50 and 100 * c["n_repeat_words"] <= 50 * c["n_words"] for c in counts]
    return [r for r, v, ok in zip(rows, votes, passed) if ok and good[v] >= 0.5]


def test_against_brute_force(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = judged(rows)
    assert 0 < len(kept) < len(rows)
    groups = test_ngram_join.brute([(r["doc_id"], r["text"]) for r in kept])
    first = {d for d, _, c in groups if d == c}
    single = [r for r in kept if r["doc_id"] in first]
    assert len(single) < len(kept)
    leaky = {d for d, *_ in test_decontaminate.brute([(r["doc_id"], r["text"]) for r in single], items)}
    clean = [r for r in single if r["doc_id"] not in leaky]
    assert len(clean) < len(single)
    path, pattern = bpe.multilingual()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    field, want, changed = pii.default_field(), [], 0
    for r in clean:
        text = pii.masked(r["text"], pii.spans(r["text"], pii.base_spans(r["text"]), field))
        changed += text != r["text"]
        ids = library.encode_ordinary(text)
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert changed
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(want)


def test_stages_take_odd_rows(spark):
    prose = " ".join(f"word{k} and then." for k in range(60))
    rows = [(1, prose, "en", "s", 1), (1, prose, "en", "s", 1), (None, prose + " more", None, None, None), (3, None, "en", "s", None), (4, "", "en", "s", 0), (5, "mail a@b.example.com " + prose[::-1], "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, given, SF)
            assert out.columns == docs.columns, name
            assert out.count() <= len(rows)
        assert corpus_pipeline.STAGES[-1][1](spark, given, SF).count() == given.count()
    masked = corpus_pipeline.personal_data(spark, docs, SF).collect()
    assert masked[5]["text"].startswith("mail [EMAIL] ") and masked[5]["n_chars"] == len(masked[5]["text"]) and masked[3]["text"] is None


def tables_at(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_run_on_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert corpus_pipeline.run(spark, tables_at(spark, tmp_path, docs)).count() == 0


def test_run_on_odd_rows_and_clashing_columns(spark, tmp_path):
    names = ("ids", "starts", "data", "score", "lang_pred", "lettered", "copy", "row", "hot", "key", "spans", "kept", "n_words", "_quality_kept", "leaky", "doc", "component")
    prose = " ".join(f"word{k} and then." for k in range(60))
    rows = [(1, prose), (1, prose), (None, prose[::-1]), (3, None), (4, ""), (5, "mail a@b.example.com " + prose.title() + " end"), (6, prose * 3000), (7, "12 34 " * 5000)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[docs.lang.alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    got = corpus_pipeline.run(spark, tables_at(spark, tmp_path, docs)).collect()
    assert [r["doc_id"] for r in got if r["doc_id"] == 1] == [1] and {r["doc_id"] for r in got} <= {1, None, 5, 6}
