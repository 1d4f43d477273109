"""Benchmark decontamination: approximate search for test items by the pigeonhole principle and bit-parallel edit distance."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from clausemill.llm.common import memo_of, texts_of, trim

WORD = re.compile(r"\w+")
ERROR_SHARE = 0.05
BLOCK_CHARS = 1_000_000


def normal(text: str) -> str:
    """Lower-cased words with one space between them."""
    return " ".join(WORD.findall(text.lower()))


def budget(item: str, share: float) -> int:
    return int(len(item) * share)


def cut(item: str, pieces: int) -> list[tuple[int, str]]:
    """(offset, piece) of an item cut into nearly equal pieces."""
    edges = [len(item) * i // pieces for i in range(pieces + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


class Pattern:
    """Edit distance of a fixed pattern to the closest part of a text, one machine word of bits per pattern."""

    def __init__(self, pattern: str):
        self.size = len(pattern)
        self.bits: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.bits[c] = self.bits.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """Least distance and the end (exclusive) of the first part that has it."""
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        plus, minus, score = full, 0, self.size
        least, end = score, 0
        for at, c in enumerate(text, 1):
            eq = self.bits.get(c, 0)
            vertical = eq | minus
            across = (((eq & plus) + plus) ^ plus) | eq
            up = minus | full & ~(across | plus)
            down = plus & across
            if up & top:
                score += 1
            elif down & top:
                score -= 1
                if score < least:
                    least, end = score, at
            up, down = up << 1 & full, down << 1 & full
            plus = down | full & ~(vertical | up)
            minus = up & vertical
        return least, end


class Searcher:
    """Finds the items of one block within their error budgets."""

    def __init__(self, items: list[tuple[object, str]], share: float):
        self.ids = [i for i, _ in items]
        self.items = [t for _, t in items]
        self.budgets = [budget(t, share) for t in self.items]
        self.patterns = [Pattern(t) for t in self.items]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, t in enumerate(self.items):
            for offset, piece in cut(t, self.budgets[n] + 1):
                pieces.setdefault(piece, []).append((n, offset))
        self.tree = ahocorasick.Automaton()
        for piece, at in pieces.items():
            self.tree.add_word(piece, (len(piece), at))
        self.tree.make_automaton()
        self.tried: dict[tuple[int, str], tuple[int, int]] = {}

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item number, distance, start of the searched window, end) of every item found, its closest place."""
        starts: dict[int, set[int]] = {}
        for last, (size, at) in self.tree.iter(text):
            for n, offset in at:
                starts.setdefault(n, set()).add(last + 1 - size - offset)
        found = []
        for n, places in starts.items():
            item, k = self.items[n], self.budgets[n]
            exact = [s for s in places if s >= 0 and text.startswith(item, s)]
            if exact:
                found.append((n, 0, min(exact), min(exact) + len(item)))
                continue
            best = None
            for low, high in merged(sorted(places), k):
                a, b = max(0, low - k), high + len(item) + k
                key = n, text[a:b]
                hit = self.tried.get(key)
                if hit is None:
                    hit = self.tried[key] = self.patterns[n].best(key[1])
                    trim(self.tried, 20_000)
                if hit[0] <= k and (best is None or hit[0] < best[1]):
                    best = n, hit[0], a, a + hit[1]
            if best:
                found.append(best)
        return found


def merged(places: list[int], gap: int) -> Iterator[tuple[int, int]]:
    """Runs of start positions at most `gap` apart, as (first, last)."""
    low = high = places[0]
    for p in places[1:]:
        if p - high > gap:
            yield low, high
            low = p
        high = p
    yield low, high


def searcher(items: list[tuple[object, str]], share: float) -> Searcher:
    """The block's automaton, built once per worker."""
    key = hash((share, tuple(items)))
    own = memo_of("decontamination")
    if key not in own or own[key][0] != (share, items):
        if len(own) > 3:
            own.clear()
        own[key] = (share, items), Searcher(items, share)
    return own[key][1]


def blocks(items: DataFrame, id_col: str, text_col: str, most: int = BLOCK_CHARS) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of about `most` characters, one at a time; items without words are left out."""
    items = items.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).filter("t IS NOT NULL").distinct()
    n = math.ceil((items.agg(F.sum(F.length("t"))).first()[0] or 0) / most)
    for block in range(n):
        rows = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == block).collect()
        held = sorted(((r.i, normal(r.t)) for r in rows), key=str)
        if held := [(i, t) for i, t in held if t]:
            yield held


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
               item_text: str = "text", share: float = ERROR_SHARE) -> DataFrame:
    """doc_id, item_id, distance, start, end: every item that a document holds within the item's error budget, at its closest place.

    Texts and items are compared as lower-cased words with single spaces; start (of the window searched) and end count
    characters of that form. An item of n characters may differ by floor(share * n) insertions, deletions and replacements; one
    of its budget + 1 pieces then occurs unchanged, so no such place is missed. Items come in blocks of bounded size, and every
    block is searched in all documents. Null texts hold nothing, null or wordless items are left out; null ids and repeated
    rows are reported as they come. Empty tables give no rows. Columns other than those named are ignored.
    """
    kind, id_type = dict(items.dtypes)[item_id], to_arrow_type(items.schema[item_id].dataType)
    schema = f"doc_id long, item_id {kind}, distance int, start long, end long"
    picked = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    out = docs.sparkSession.createDataFrame([], schema)
    for held in blocks(items, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            s = searcher(held, share)
            for batch in batches:
                rows = [(k, *hit) for k, t in enumerate(texts_of(batch.column(1))) for hit in s.search(normal(t))]
                at, n, distance, start, end = zip(*rows) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), pa.array([s.ids[i] for i in n], id_type), pa.array(distance, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                    ["doc_id", "item_id", "distance", "start", "end"])

        out = out.union(picked.mapInArrow(run, schema))
    return out


def holds_item(text: Column, held: list[tuple[object, str]], share: float) -> Column:
    @F.pandas_udf("boolean")
    def flag(series: pd.Series) -> pd.Series:
        s = searcher(held, share)
        return series.map(lambda t: bool(t) and bool(s.search(normal(t)))).astype(bool)

    return flag(text)


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                  share: float = ERROR_SHARE) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text holds none of the items; rules as in `find_items`."""
    for held in blocks(items, item_id, item_text):
        docs = docs.filter(~holds_item(F.col(text_col).cast("string"), held, share))
    return docs
