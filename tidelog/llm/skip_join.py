"""Set-relation skipping within one group of sets: components of similar sets, exactly.

Index skipping.  Tokens are ranked rare first; the index holds each set's
prefix, its lists are ordered by the token's position in the set, and a probe
reads a list only up to the last position at which enough tokens can follow.

Answer skipping.  The overlaps of a set with all others are its answer.  A set
close to one already answered takes that answer and corrects it by the tokens
in which the two differ, rather than counting anew.  Sets known to be of one
component are not compared; and once all sets outside the largest component
are answered, no pair across components is left, so its rest is not probed.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np

#: Answers kept to derive others from.
KEPT_ANSWERS = 8
#: Up to so many candidates are compared one by one.
FEW = 4


def linked(overlap, n, m, percent: int = 80):
    return 100 * overlap >= percent * (n + m - overlap)


class Index:
    """Lists of the sets that hold each token, for counting overlaps with many sets at once."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)
        order = np.argsort(tokens, kind="stable")
        ranked = tokens[order]
        first = np.append(True, ranked[1:] != ranked[:-1]) if len(ranked) else np.zeros(0, bool)
        self.keys = ranked[first]
        self.bounds = np.append(np.flatnonzero(first), len(ranked))
        self.owners = owner[order]
        self.tokens, self.owner, self.order, self.first = tokens, owner, order, first

    def overlaps(self, s: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, s)
        at[at == len(self.keys)] = 0
        return self.counted(at[self.keys[at] == s]) if len(self.keys) else np.zeros(len(self.sizes), np.int64)

    def counted(self, lists: np.ndarray) -> np.ndarray:
        return np.bincount(gathered(self.owners, self.bounds[lists], self.bounds[lists + 1]), minlength=len(self.sizes))


def gathered(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The values of many slices, one after another."""
    n = np.maximum(ends - starts, 0)
    return values[np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())]


class Group:
    """Sets to be joined with one another; labels() gives each set's component.

    known: for each set a name of the component that it is known to be of, if any.
    """

    def __init__(self, sets: list[np.ndarray], percent: int = 80, known: list[int] | None = None):
        self.percent = percent
        self.index = Index(sets)
        sizes = self.sizes = self.index.sizes
        often = np.diff(self.index.bounds)
        rank_of_list = np.empty(len(often), dtype=np.int64)
        rank_of_list[np.argsort(often, kind="stable")] = np.arange(len(often))
        self.list_of_rank = np.argsort(rank_of_list)
        token_rank = np.empty(len(self.index.tokens), dtype=np.int64)
        token_rank[self.index.order] = np.repeat(rank_of_list, often)
        place = np.argsort(self.index.owner.astype(np.int64) * max(1, len(often)) + token_rank, kind="stable")
        self.ranks = token_rank[place]
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        position = np.arange(len(place)) - np.repeat(self.starts[:-1], sizes)
        self.prefix = sizes - (-(-percent * sizes // 100)) + 1
        kept = np.flatnonzero((position < np.repeat(self.prefix, sizes)) & (often[self.list_of_rank[self.ranks]] > 1))
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[kept]
        order = np.lexsort((position[kept], self.ranks[kept]))
        self.list_sets, self.list_positions = owner[order], position[kept][order]
        self.list_bounds = np.searchsorted(self.ranks[kept][order], np.arange(len(often) + 1))
        self.up = list(range(len(sizes)))
        self.members = [1] * len(sizes)
        self.answers: OrderedDict[int, np.ndarray] = OrderedDict()
        first: dict[int, int] = {}
        for x, name in enumerate(known or []):
            self.unite(first.setdefault(name, x), x)

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def unite(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            if self.members[x] < self.members[y]:
                x, y = y, x
            self.up[y] = x
            self.members[x] += self.members[y]

    def tokens(self, x: int) -> np.ndarray:
        return self.ranks[self.starts[x] : self.starts[x + 1]]

    def candidates(self, x: int) -> np.ndarray:
        """Sets that may be similar to x, by prefix, position and size."""
        n, p = int(self.sizes[x]), self.percent
        own = self.tokens(x)[: int(self.prefix[x])]
        at = np.arange(len(own))
        # With overlap o >= p (n + m) / (100 + p) and o <= n - i, the other set has at most m tokens,
        # and a position j in it leaves m - j >= o.
        most = np.minimum(100 * n // p, (n - at) * (100 + p) // p - n)
        last = (100 * most - p * n) // (100 + p)
        starts, ends = self.list_bounds[own], self.list_bounds[own + 1]
        for k in np.flatnonzero(ends > starts).tolist():
            ends[k] = starts[k] + np.searchsorted(self.list_positions[starts[k] : ends[k]], last[k], side="right")
        found = np.unique(gathered(self.list_sets, starts, ends))
        m = self.sizes[found]
        return found[(100 * np.minimum(m, n) >= p * np.maximum(m, n)) & (found != x)]

    def answer(self, x: int) -> np.ndarray:
        """The overlaps of x with all sets, from the answer of a close set if that is less work."""
        own, n = self.tokens(x), int(self.sizes[x])
        often = np.diff(self.index.bounds)
        work, near = int(often[self.list_of_rank[own]].sum()), -1
        for other, told in self.answers.items():
            differ = n + int(self.sizes[other]) - 2 * int(told[x])
            if 2 * differ < n:
                theirs = self.tokens(other)
                less, more = np.setdiff1d(theirs, own, assume_unique=True), np.setdiff1d(own, theirs, assume_unique=True)
                cost = int(often[self.list_of_rank[less]].sum() + often[self.list_of_rank[more]].sum())
                if cost < work:
                    work, near, parts = cost, other, (less, more)
        if near >= 0:
            less, more = parts
            told = self.answers[near] - self.index.counted(self.list_of_rank[less]) + self.index.counted(self.list_of_rank[more])
            self.answers.move_to_end(near)
        else:
            told = self.index.counted(self.list_of_rank[own])
            self.answers[x] = told
            if len(self.answers) > KEPT_ANSWERS:
                self.answers.popitem(last=False)
        return told

    def probe(self, x: int) -> None:
        found = self.candidates(x)
        own = self.root(x)
        found = np.array([y for y in found.tolist() if self.root(y) != own], dtype=np.int64)
        if not len(found):
            return
        if len(found) <= FEW:
            overlap = np.array([len(np.intersect1d(self.tokens(x), self.tokens(y), assume_unique=True)) for y in found.tolist()])
        else:
            overlap = self.answer(x)[found]
        for y in found[linked(overlap, self.sizes[x], self.sizes[found], self.percent)].tolist():
            self.unite(x, y)

    def labels(self) -> list[int]:
        n = len(self.sizes)
        if n == 2 and self.root(0) != self.root(1):
            both = len(np.intersect1d(self.tokens(0), self.tokens(1), assume_unique=True))
            if linked(both, self.sizes[0], self.sizes[1], self.percent):
                self.unite(0, 1)
        elif n > 2:
            shared = np.add.reduceat(np.diff(self.index.bounds)[self.list_of_rank[self.ranks]], self.starts[:-1])
            largest, deferred = -1, []
            for x in np.argsort(-shared, kind="stable").tolist():  # those of large clusters first
                r = self.root(x)
                if self.members[r] > 1 and (largest < 0 or self.members[r] >= self.members[self.root(largest)]):
                    largest = r
                    deferred.append(x)
                else:
                    self.probe(x)
            left: dict[int, int] = {}
            for x in deferred:
                left[self.root(x)] = left.get(self.root(x), 0) + 1
            spared = max(left, key=lambda r: (left[r], -r), default=-1)
            apart = [x for x in deferred if self.root(x) != spared]
            for x in apart:
                self.probe(x)
        return [self.root(x) for x in range(n)]
