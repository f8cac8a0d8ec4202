"""Quality rules as weak supervision.

Rules vote good, bad or abstain on each document.  The votes of all documents
are counted by vote pattern (at most 3 ** rules patterns, whatever the corpus),
expectation-maximisation over those counts estimates the share of good
documents and how often each rule votes which way, or abstains, on good and on
bad ones, hence its accuracy; and the posterior probability of good replaces
an all-must-pass filter.  A posterior of a half or more keeps, so a tie keeps:
where no rule tells the classes apart, say in a table without any vote, every
posterior is a half.

Null texts have no words and count as empty.  A text is counted whole; its
words are hashed piece by piece, and of a very long one a few numbers a word
are held.  Words, lines and windows are told apart by 64-bit hashes within
their text.  Rows are judged one by one, so repeated rows and null ids need no
care, and an empty table gives no rows.  Columns other than the text are passed
through or ignored; the counts have names that no column has.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import wordhash as W
from tidelog.llm.common import map_batches, tables, with_columns, written

#: Fixed values of the base counts.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_shouts", "n_stops")

_symbol = np.zeros(256, dtype=bool)
_symbol[list(SYMBOLS)] = True


def _per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs again anywhere, and whether it occurred before."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(len(keys) + 1, dtype=bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    anywhere, before = np.empty(len(keys), bool), np.empty(len(keys), bool)
    before[order] = same[:-1]
    anywhere[order] = same[:-1] | same[1:]
    return anywhere, before


def _salted(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Keys that are equal only within one row; rows: first key of each row, and the total."""
    salt = W.mix(np.arange(1, len(rows), dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    return keys ^ np.repeat(salt, np.diff(rows))


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each row's whole text."""
    raw, offsets = W.utf8_buffer(column)
    rows = len(offsets) - 1
    words, starts, first = W.word_hashes(raw, offsets, lower=False)
    out = {"n_words": np.diff(first)}
    solid = ~W.SPACE[raw]
    out["word_chars"] = _per_row(solid & ((raw & 0xC0) != 0x80), offsets)
    out["n_symbols"] = _per_row(_symbol[raw], offsets)

    lines, _, line_first, worded = W.line_hashes(raw, offsets, starts)
    keep = np.flatnonzero(worded)
    kept_first = np.searchsorted(keep, line_first)
    _, before = _repeated(_salted(lines[keep], kept_first))
    out["n_dup_lines"] = _per_row(before, kept_first)
    out["n_lines"] = np.diff(kept_first)

    runs = W.window_hashes(words, WINDOW)
    covered = np.zeros(len(words), dtype=bool)
    if len(runs):
        owner = np.repeat(np.arange(rows), np.diff(first))
        whole = np.flatnonzero(owner[: len(runs)] == owner[WINDOW - 1 :])
        again, _ = _repeated(_salted(runs[whole], np.searchsorted(whole, first)))
        for k in range(WINDOW):
            covered[whole[again] + k] = True
    out["n_repeat_words"] = _per_row(covered, first)

    upper = (raw >= 65) & (raw <= 90)
    out["n_upper"] = _per_row(upper, offsets)
    out["n_letters"] = _per_row(upper | ((raw >= 97) & (raw <= 122)), offsets)
    out["n_shouts"] = _per_row(raw == 33, offsets)
    out["n_stops"] = _per_row(raw == 46, offsets)
    return {name: out[name].astype(np.int64) for name in COUNTS}


def with_counts(docs: DataFrame, column: str = "text", prefix: str = "") -> DataFrame:
    """The frame with COUNTS of its text column appended, each named prefix + name."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = text_counts(batch.column(column))
        return with_columns(batch, {f"{prefix}{k}": pa.array(v) for k, v in found.items()})

    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"{prefix}{k} bigint" for k in COUNTS])
    return map_batches(docs, make, kinds, column)


@dataclass(frozen=True)
class Rule:
    """Votes 1 (good) or -1 (bad) where all of its ratio tests hold, else abstains.

    A test is (count, count it is divided by, least, most); one whose divisor is 0 fails.
    """

    name: str
    says: int
    tests: tuple[tuple[str, str, float, float], ...]

    def vote(self, prefix: str = "") -> Column:
        holds = F.lit(True)
        for top, bottom, least, most in self.tests:
            ratio = F.col(prefix + top) / F.when(F.col(prefix + bottom) != 0, F.col(prefix + bottom))
            holds = holds & ratio.between(least, most)
        return F.when(holds, self.says).otherwise(0)


NONE, ANY = 0.0, float("inf")
#: The default rules.
RULES = (
    Rule("symbols", -1, (("n_symbols", "n_words", 0.10, ANY),)),
    Rule("repeats", -1, (("n_repeat_words", "n_words", 0.45, ANY),)),
    Rule("lines", -1, (("n_dup_lines", "n_lines", 0.30, ANY),)),
    Rule("capitals", -1, (("n_upper", "n_letters", 0.40, ANY),)),
    Rule("shouts", -1, (("n_shouts", "n_words", 0.10, ANY),)),
    Rule("short words", -1, (("word_chars", "n_words", NONE, 2.0),)),
    Rule("long words", -1, (("word_chars", "n_words", 14.0, ANY),)),
    Rule("prose", 1, (("n_symbols", "n_words", NONE, 0.02), ("n_upper", "n_letters", NONE, 0.15), ("n_shouts", "n_words", NONE, 0.02), ("n_stops", "n_words", 0.01, 0.35), ("n_repeat_words", "n_words", NONE, 0.4))),
)


def base_failed(prefix: str = "") -> Column:
    n = F.col(f"{prefix}n_words")
    return (n < MIN_WORDS) | (100 * F.col(f"{prefix}n_repeat_words") > MAX_REPEAT_PERCENT * n)


def pattern(rules: tuple[Rule, ...], prefix: str = "") -> Column:
    """The votes as one number to base 3, the first rule lowest."""
    return sum(((r.vote(prefix) + 1) * 3**k for k, r in enumerate(rules)), F.lit(0)).cast("int")


def votes_of(code: int, rules: int) -> list[int]:
    return [code // 3**k % 3 - 1 for k in range(rules)]


@dataclass
class LabelModel:
    """balance: the share of good documents.  rates[j]: of rule j the chances of a bad vote, none and a good one, on bad and on good documents."""

    balance: float
    rates: list[tuple[tuple[float, float, float], tuple[float, float, float]]]

    @property
    def accuracy(self) -> list[float]:
        """Of each rule the chance that its vote is right."""
        out = []
        for bad, good in self.rates:
            right = (1 - self.balance) * bad[0] + self.balance * good[2]
            out.append(right / (right + (1 - self.balance) * bad[2] + self.balance * good[0]))
        return out

    def weight(self, j: int, vote: int) -> float:
        """What that vote of rule j, or its abstaining, adds to the log odds of good."""
        bad, good = self.rates[j]
        return math.log(good[vote + 1]) - math.log(bad[vote + 1])

    def posterior(self, votes: list[int]) -> float:
        odds = math.log(self.balance) - math.log(1 - self.balance) + sum(self.weight(j, v) for j, v in enumerate(votes))
        return 1 / (1 + math.exp(-odds)) if odds > -700 else 0.0


#: The least chance that a fitted rate may have.
LEAST = 1e-4


def fit(counts: dict[int, int], rules: int, rounds: int = 500, trust: float = 0.85, belief: float = 0.1) -> LabelModel:
    """Expectation-maximisation over vote-pattern counts; alike at every corpus size.

    It starts from an even balance and rules of accuracy ``trust`` that abstain
    equally often on both classes.  ``belief`` is the weight of that start
    against what the votes say, so that rules which never meet another keep
    near it.
    """
    codes = sorted(counts)
    votes = np.array([votes_of(c, rules) for c in codes], dtype=np.int64).reshape(len(codes), rules)
    weight = np.array([counts[c] for c in codes], dtype=float)
    total = max(weight.sum(), 1.0)
    cast = np.stack([(weight[:, None] * (votes == v)).sum(axis=0) / total for v in (-1, 0, 1)], axis=1)  # rule, vote
    start = np.empty((rules, 2, 3))
    for label, right in ((0, 0), (1, 2)):
        start[:, label, right] = np.minimum(2 * trust * cast[:, right], 0.99)
        start[:, label, 2 - right] = np.minimum(2 * (1 - trust) * cast[:, 2 - right], 0.99)
        start[:, label, 1] = np.maximum(LEAST, 1 - start[:, label, 0] - start[:, label, 2])
    start = np.maximum(start, LEAST)
    start /= start.sum(axis=2, keepdims=True)
    rates, balance = start, 0.5
    for _ in range(rounds if len(codes) else 0):
        chosen = np.log(rates)[np.arange(rules)[None, :, None], np.arange(2)[None, None, :], votes[:, :, None] + 1].sum(axis=1)
        good = 1 / (1 + np.exp(np.clip(chosen[:, 0] - chosen[:, 1] + math.log(1 - balance) - math.log(balance), -700, 700)))
        share = np.stack([weight * (1 - good), weight * good])  # label, pattern
        seen = np.stack([share @ (votes == v) for v in (-1, 0, 1)], axis=2).transpose(1, 0, 2)  # rule, label, vote
        mass = share.sum(axis=1)
        now = np.where(mass[None, :, None] > 0, seen / np.maximum(mass, 1e-300)[None, :, None], start)
        now = np.maximum((1 - belief) * now + belief * start, LEAST)
        now /= now.sum(axis=2, keepdims=True)
        balance = (1 - belief) * mass[1] / total + belief * 0.5
        moved = np.abs(now - rates).max(initial=0.0)
        rates = now
        if moved < 1e-10:
            break
    return LabelModel(float(balance), [tuple(tuple(r) for r in rule) for rule in rates.tolist()])


def fit_votes(counted: DataFrame, rules: tuple[Rule, ...] = RULES, prefix: str = "") -> LabelModel:
    """The label model of all rows; only vote-pattern counts come to the driver."""
    found = counted.groupBy(pattern(rules, prefix).alias("code")).count().collect()
    return fit({r["code"]: r["count"] for r in found}, len(rules))


def posterior(model: LabelModel, rules: tuple[Rule, ...] = RULES, prefix: str = "") -> Column:
    """Posterior probability of good, from the votes, within generated code."""
    odds = F.lit(math.log(model.balance) - math.log(1 - model.balance))
    for j, rule in enumerate(rules):
        said = rule.vote(prefix) == rule.says
        odds = odds + F.when(said, model.weight(j, rule.says)).otherwise(model.weight(j, 0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def judge(counted: DataFrame, rules: tuple[Rule, ...] = RULES, prefix: str = "") -> DataFrame:
    """A counted frame with base_failed, posterior and kept."""
    model = fit_votes(counted, rules, prefix)
    good = posterior(model, rules, prefix)
    return counted.withColumns({f"{prefix}base_failed": base_failed(prefix), f"{prefix}posterior": good, f"{prefix}kept": ~base_failed(prefix) & (good >= 0.5)})


def keep_good(docs: DataFrame, column: str = "text") -> DataFrame:
    """The documents that pass, all columns as they were.  Each text is counted once, the rows being written with their counts."""
    prefix = "_quality_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    counted, _ = written(with_counts(docs, column, prefix), "quality-counts")
    return judge(counted, prefix=prefix).filter(F.col(f"{prefix}kept")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents").select("doc_id", "text")
    counted, _ = written(with_counts(docs).drop("text"), "quality-counts")
    out = judge(counted)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
