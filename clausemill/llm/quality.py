"""Quality by a factorisation machine over hashed words, structure statistics and size."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.functions.scale import stored
from clausemill.llm.common import held_out, labelled_sample, texts_of, trim

WORD_SLOTS = 1 << 16
BINS = 12
LABELLED = {0: 3_000, 1: 5_000}  # labelled rows learned from, at most
RANK, EPOCHS, BATCH, RATE, DECAY = 8, 6, 200, 0.1, 1e-4
THRESHOLD = 0.3
MARKS = "%$#&*|!"


def statistics(text: str, words: list[str]) -> list[float]:
    """Structure and size, each scaled so that most values fall into 0 to 1."""
    n = max(len(words), 1)
    lines = text.split("\n")
    return [
        sum(map(str.isupper, words)) / n,
        min(1.0, sum(map(text.count, MARKS)) / n / 3),
        text.count("|") / n,
        text.count("!") / n / 2,
        sum(w.isdigit() for w in words) / n,
        len(set(words)) / n,
        len(set(lines)) / len(lines),
        min(1.0, len(text) / n / 16),
        min(1.0, text.count(".") / n * 3),
        min(1.0, text.count(",") / n * 3),
        min(1.0, math.log1p(n) / 12),
        min(1.0, math.log1p(len(lines)) / 8),
        min(1.0, max(map(len, lines)) / max(len(text), 1)),
    ]


N_STATISTICS = len(statistics("", []))
SLOTS = WORD_SLOTS + N_STATISTICS * BINS


class Features:
    """Sparse rows: distinct words at hashed slots with one norm in all, and one slot per binned statistic."""

    def __init__(self, most: int = 300_000):
        self.slots: dict[str, int] = {}
        self.most = most

    def row(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        distinct, slots = set(words), self.slots
        for w in distinct.difference(slots):
            slots[w] = zlib.crc32(w.encode()) % WORD_SLOTS
        own = sorted({slots[w] for w in distinct})
        trim(slots, self.most)
        stats = [WORD_SLOTS + i * BINS + min(int(v * BINS), BINS - 1) for i, v in enumerate(statistics(text, words))]
        values = np.ones(len(own) + len(stats), np.float32)
        values[: len(own)] = 1 / math.sqrt(max(len(own), 1))
        return np.array(own + stats, np.int32), values


@dataclass
class Machine:
    """y = bias + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j."""

    bias: float
    w: np.ndarray
    v: np.ndarray

    def logits(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """In linear time: the pairwise sum is half of the squared sums less the sums of squares."""
        index, value, starts = stacked(rows)
        terms = self.v[index] * value[:, None]
        sums = np.add.reduceat(terms, starts)
        squares = np.add.reduceat(terms * terms, starts)
        linear = np.add.reduceat(self.w[index] * value, starts)
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1)


def stacked(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(i) for i, _ in rows])
    return np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows]), np.cumsum(sizes) - sizes


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, seed: int = 0) -> Machine:
    """Weighted log loss by mini-batches with per-parameter step sizes."""
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(SLOTS, np.float32), rng.normal(0, 0.05, (SLOTS, RANK)).astype(np.float32))
    gw, gv, gb = np.full(SLOTS, 1e-6, np.float32), np.full((SLOTS, RANK), 1e-6, np.float32), 1e-6
    weight = weight / weight.mean() if len(weight) else weight
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            pick = order[at : at + BATCH]
            own = [rows[i] for i in pick]
            index, value, starts = stacked(own)
            owner = np.repeat(np.arange(len(own)), [len(i) for i, _ in own])
            terms = m.v[index] * value[:, None]
            sums = np.add.reduceat(terms, starts)
            logit = m.bias + np.add.reduceat(m.w[index] * value, starts) + 0.5 * (sums**2 - np.add.reduceat(terms**2, starts)).sum(axis=1)
            slope = (weight[pick] * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[pick]) / len(own)).astype(np.float32)
            used, where = np.unique(index, return_inverse=True)
            each = slope[owner] * value
            dw = np.bincount(where, each, len(used)) + DECAY * m.w[used]
            inner = each[:, None] * (sums[owner] - terms)
            dv = np.column_stack([np.bincount(where, inner[:, f], len(used)) for f in range(RANK)]) + DECAY * m.v[used]
            db = float(slope.sum())
            gw[used] += dw**2
            gv[used] += dv**2
            gb += db * db
            m.w[used] -= RATE * dw / np.sqrt(gw[used])
            m.v[used] -= RATE * dv / np.sqrt(gv[used])
            m.bias -= RATE * db / math.sqrt(gb)
    return m


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, held: int = 0, most: dict[int, int] | None = None) -> Machine:
    """Learns from at most LABELLED rows per label outside the held-out ones. Features are made by the tasks; the driver sees this bounded sample only."""
    sample = labelled_sample(docs, labels, label, modulus, held, most or LABELLED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features()
        for batch in batches:
            rows = [f.row(t) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([i.tobytes() for i, _ in rows], pa.binary()), pa.array([x.tobytes() for _, x in rows], pa.binary()), batch.column(2), batch.column(3)],
                ["id", "i", "x", "y", "w"])

    made = sample.select("id", "text", "label", "weight").mapInArrow(run, "id long, i binary, x binary, y int, w double")
    got = stored(made, "quality").toArrow().sort_by([("id", "ascending"), ("i", "ascending")])
    rows = [(np.frombuffer(i, np.int32), np.frombuffer(x, np.float32)) for i, x in zip(got["i"].to_pylist(), got["x"].to_pylist())]
    return fit(rows, got["y"].to_numpy().astype(float), got["w"].to_numpy().astype(float))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, held: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; the score reads the text only.

    Null and empty texts are scored by their statistics. A null id is not held out. Repeated rows are repeated, an empty table
    gives no rows, columns other than the two named are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                logit = machine.logits([f.row(t) for t in texts_of(part.column(1))])
                p = pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30).astype(float))), pa.float64())
                yield pa.RecordBatch.from_arrays([part.column(0), p], ["doc_id", "score"])

    scored = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), modulus, held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
