"""Exact best documents of many queries over a slice of postings that a task holds (R2), without looking at all pairs."""

from __future__ import annotations

import numpy as np

SLICE_POSTINGS = 4_000_000  # postings that a task holds at once
FREQUENT_CELLS = 16_000_000  # places of frequent terms by document
SLACK = 1e-5  # scores are ranked at six places


class Queries:
    """Weighted terms of n queries, heaviest first in each: owner, term, weight, `first` entry of a query, and `rest`, the positive
    weights from an entry on. The last entry of every query has no weight and the term 0."""

    def __init__(self, owner: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int):
        owner = np.concatenate([owner, np.arange(n)])
        term, weight = np.concatenate([term, np.zeros(n, np.int64)]), np.concatenate([weight, np.zeros(n)])
        last = np.arange(len(owner)) >= len(owner) - n
        order = np.lexsort((-weight, last, owner))
        self.owner, self.term, self.weight, self.n = owner[order], term[order], weight[order], n
        self.first = np.searchsorted(self.owner, np.arange(n + 1))
        sums = np.concatenate([[0], np.cumsum(np.maximum(self.weight, 0))])
        self.rest = np.maximum(sums[self.first[self.owner + 1]] - sums[:-1], 0)
        self.rest[self.first[1:] - 1] = 0
        self.last = last[order]


class Slice:
    """Postings of `rows` documents by term; documents are numbered by the largest part of a posting, in falling order, so that
    those that can reach a score stand at the beginning of every term."""

    def __init__(self, row: np.ndarray, term: np.ndarray, part: np.ndarray, rows: int, terms: int):
        cuts = np.searchsorted(row, np.arange(rows + 1))
        held = np.flatnonzero(np.diff(cuts))
        top = np.maximum.reduceat(part, cuts[held]) if len(held) else np.empty(0)
        order = np.argsort(-top, kind="stable")
        self.row, self.top, self.n = held[order], top[order], len(held)
        number = np.empty(rows, np.int64)
        number[self.row] = np.arange(self.n)
        key = term * self.n + number[row]
        order = np.argsort(key)
        self.key, self.part = key[order], part[order]
        self.start = np.searchsorted(self.key, np.arange(terms + 1) * self.n)
        self.doc = (self.key - np.repeat(np.arange(terms) * self.n, np.diff(self.start))).astype(np.int32)
        size = np.diff(self.start)
        some = np.argsort(-size)[: FREQUENT_CELLS // max(self.n, 1)]
        some = some[size[some] > self.n // 64]
        self.frequent = np.full(terms, -1)
        self.frequent[some] = np.arange(len(some))
        self.place = np.full((len(some), self.n), -1, np.int32)
        for i, t in enumerate(some):
            self.place[i, self.doc[self.start[t] : self.start[t + 1]]] = np.arange(self.start[t], self.start[t + 1])

    def parts(self, term: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Part of each (term, document), 0 where the document does not have the term."""
        f = self.frequent[term]
        at = self.place[f, doc] if len(self.place) else np.full(len(term), -1)
        rare = np.flatnonzero(f < 0)
        key = term[rare] * self.n + doc[rare]
        found = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        at[rare] = np.where(self.key[found] == key, found, -1)
        return np.where(at >= 0, self.part[at], 0.0)


def places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of runs of `size` from `start`, one run behind the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


def blocks(q: Queries, size: np.ndarray, cells: int):
    """First and last query of blocks whose entries have about `cells` postings."""
    ends = np.concatenate([[0], np.cumsum(size)])[q.first]
    first = 0
    while first < q.n:
        last = max(int(np.searchsorted(ends, ends[first] + cells, "right")) - 1, first + 1)
        yield first, min(last, q.n)
        first = min(last, q.n)


def added(q: Queries, s: Slice, first: int, last: int, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, document, score) from the first `size` postings of every entry of queries first to last."""
    lo, hi = q.first[first], q.first[last]
    entry = np.repeat(np.arange(lo, hi), size[lo:hi])
    at = places(s.start[q.term[lo:hi]], size[lo:hi])
    pair = (q.owner[entry] - first) * s.n + s.doc[at]
    part = q.weight[entry] * s.part[at]
    order = np.argsort(pair)
    pair = pair[order]
    new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])[: len(pair)])
    score = np.add.reduceat(part[order], new) if len(new) else np.empty(0)
    return pair[new] // s.n + first, pair[new] % s.n, score


def finished(q: Queries, s: Slice, who: np.ndarray, doc: np.ndarray, score: np.ndarray, entry: np.ndarray, least: np.ndarray):
    """(query, document, score) in full of the pairs that reach `least` of their query. A pair has the score of the entries before
    `entry`; the others are added one at a time, and a pair goes as soon as the entries left cannot lift it to `least`."""
    out = [(who[:0], doc[:0], score[:0])]
    while len(who):
        able = np.flatnonzero(score + s.top[doc] * q.rest[entry] >= least[who])
        who, doc, score, entry = who[able], doc[able], score[able], entry[able]
        ended = q.last[entry]
        if ended.any():
            out.append((who[ended], doc[ended], score[ended]))
            more = np.flatnonzero(~ended)
            who, doc, score, entry = who[more], doc[more], score[more], entry[more]
        score = score + q.weight[entry] * s.parts(q.term[entry], doc)
        entry = entry + 1
    who, doc, score = (np.concatenate(x) for x in zip(*out))
    return who[score > 0], doc[score > 0], score[score > 0]


def first_bounds(q: Queries, s: Slice, k: int, least: np.ndarray, cells: int, few: int = 256) -> np.ndarray:
    """`least` where it is known; else a score that k documents reach, from about `few` postings of the heaviest terms of a query."""
    size = np.where((least[q.owner] > 0) | (q.weight <= 0), 0, s.start[q.term + 1] - s.start[q.term])
    before = np.cumsum(size) - size
    size = np.minimum(size, np.maximum(1, few - (before - before[q.first[q.owner]])))
    least = least.copy()
    for first, last in blocks(q, size, cells):
        who, doc, score = added(q, s, first, last, size)
        order = np.lexsort((-score, who))
        order = order[placed(who[order]) < 4 * k]
        who, doc, score = finished(q, s, who[order], doc[order], np.zeros(len(order)), q.first[who[order]], np.zeros(q.n))
        order = np.lexsort((-score, who))
        order = order[placed(who[order]) == k - 1]
        least[who[order]] = score[order]
    return least


def placed(sorted_numbers: np.ndarray) -> np.ndarray:
    """Place of every row among those of its number, from 0."""
    return np.arange(len(sorted_numbers)) - np.searchsorted(sorted_numbers, sorted_numbers, "left")


def best_pairs(q: Queries, s: Slice, k: int, least: np.ndarray, cells: int):
    """(query, document, score) blocks with the k best documents of every query that reach `least` (0 if unknown), and others.

    A document whose heaviest common term is entry j has at most its largest part times the weights from j on. So only the
    first documents of each term's postings can bring in a new pair, and light terms, whose postings are long, bring in none.
    """
    if not s.n or not len(q.owner):
        return
    least = np.maximum(first_bounds(q, s, k, least, cells) - SLACK, 0.0)
    reach = np.divide(least[q.owner], q.rest, out=np.full(len(q.rest), np.inf), where=q.rest > 0)
    limit = np.where(q.weight > 0, np.searchsorted(-s.top, -reach, "right"), 0)  # documents that an entry can bring in
    size = np.searchsorted(s.key, q.term * s.n + limit) - s.start[q.term]
    for first, last in blocks(q, size, cells):
        who, doc, score = added(q, s, first, last, size)
        lo, hi = q.first[first], q.first[last]
        falling = (q.owner[lo:hi] - first) * (s.n + 1) + s.n - limit[lo:hi]
        entry = lo + np.searchsorted(falling, (who - first) * (s.n + 1) + s.n - doc)  # the entries before it are in the score
        yield finished(q, s, who, doc, score, entry, least)
