"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words map to symbols (insult, threat, target, negation, reported speech, other). Small transducers each follow one of these and
scale or add weight; their composition reads a clause once. Insult words and word beginnings are learned from labels.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.functions.scale import stored
from clausemill.llm.common import held_out, labelled_sample, memo_of, texts_of, trim

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, BOUNDARY = range(7)
TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]")

# General words of each kind; labels correct the weights of the insults.
INSULTS = "idiot moron stupid dumb loser trash scum pathetic worthless disgusting clown imbecile bastard jerk filthy vermin".split()
THREATS = "kill murder hurt stab beat destroy strangle shoot töten umbringen matar tuer".split()
TARGETS = "you your yours yourself he she they them him his her their du dich dir dein ihr euch tú ti tu te vous toi vos".split()
NEGATIONS = "not no never isn aren wasn without nicht kein keine nie nunca jamás jamais pas".split()
REPORTS = "said says wrote writes claimed claims quoted called reported alleged sagte schrieb dijo escribió dit écrit".split()
KINDS = ((REPORTS, REPORT), (NEGATIONS, NEGATION), (TARGETS, TARGET), (THREATS, THREAT))

PRIOR_WEIGHT, THREAT_WEIGHT = 3.0, 2.0
PREFIXES = (4, 5, 6)
LABELLED = {0: 12_000, 1: 4_000}  # labelled rows learned from, at most
THRESHOLD = 0.7


@dataclass
class Transducer:
    """step[state, symbol] = (next state, factor on the word's weight, added weight); other pairs stay put with factor 1."""

    states: int
    step: dict[tuple[int, int], tuple[int, float, float]] = field(default_factory=dict)

    def read(self, state: int, symbol: int) -> tuple[int, float, float]:
        return self.step.get((state, symbol), (state, 1.0, 0.0))


def window(opens: int, span: int, scaled: dict[int, float], added: dict[int, float] | None = None) -> Transducer:
    """After symbol `opens`, the next `span` words are read in states that scale the symbols of `scaled` and reward those of `added`."""
    t = Transducer(span + 1)
    for state in range(span + 1):
        for symbol in range(BOUNDARY):
            after = span if symbol == opens else max(state - 1, 0)
            inside = state > 0
            t.step[state, symbol] = after, scaled.get(symbol, 1.0) if inside else 1.0, (added or {}).get(symbol, 0.0) if inside else 0.0
        t.step[state, BOUNDARY] = 0, 1.0, 0.0
    return t


def latch(opens: int, scaled: dict[int, float]) -> Transducer:
    """After symbol `opens`, the rest of the clause scales the symbols of `scaled`."""
    t = Transducer(2, {(0, opens): (1, 1.0, 0.0), (1, BOUNDARY): (0, 1.0, 0.0)})
    t.step |= {(1, s): (1, f, 0.0) for s, f in scaled.items()}
    return t


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Both read the same symbols; factors multiply and added weights add up."""
    out = Transducer(a.states * b.states)
    for i in range(a.states):
        for j in range(b.states):
            for symbol in range(BOUNDARY + 1):
                (x, f, p), (y, g, q) = a.read(i, symbol), b.read(j, symbol)
                out.step[i * b.states + j, symbol] = x * b.states + y, f * g, p + q
    return out


def grammar() -> Transducer:
    insult = Transducer(1)
    target = window(TARGET, 4, {INSULT: 1.3})
    threat = window(THREAT, 4, {}, {TARGET: THREAT_WEIGHT})
    negation = window(NEGATION, 3, {INSULT: 0.5, THREAT: 0.3})
    report = latch(REPORT, {INSULT: 0.6, THREAT: 0.5, TARGET: 1.0})
    out = insult
    for t in (threat, target, negation, report):
        out = compose(out, t)
    return out


LONGEST_WINDOW = 4


class Scorer:
    """Weight of a text: the sum over its clauses of what the composed transducer gives."""

    def __init__(self, weights: dict[str, float], most: int = 400_000):
        g = grammar()
        self.table = [[g.read(s, c) for c in range(BOUNDARY + 1)] for s in range(g.states)]
        # Runs of other words only let windows run out.
        self.idle = [list(range(g.states))]
        for _ in range(LONGEST_WINDOW):
            self.idle.append([self.table[s][OTHER][0] for s in self.idle[-1]])
        self.weights = weights
        self.kinds = {w: kind for words, kind in KINDS for w in words}
        self.codes: dict[str, tuple[int, float] | None] = {}
        self.most = most

    def code(self, token: str) -> tuple[int, float] | None:
        if token in ".!?;:\n":
            return BOUNDARY, 0.0
        weight = max([self.weights.get(token, 0.0), *(self.weights.get("^" + token[:n], 0.0) for n in PREFIXES if len(token) > n)])
        if weight > 0:
            return INSULT, weight
        kind = self.kinds.get(token)
        return (kind, THREAT_WEIGHT / 2 if kind == THREAT else 0.0) if kind else None

    def clauses(self, text: str) -> list[float]:
        """Weights of the clauses that have any."""
        tokens = TOKEN.findall(text.lower())
        codes = self.codes
        for t in set(tokens).difference(codes):  # a plain dict: looked up, not walked
            codes[t] = self.code(t)
        state, at, total, out = 0, -1, 0.0, []
        for i, code in enumerate(map(codes.__getitem__, tokens)):
            if code is None:
                continue
            symbol, weight = code
            state = self.idle[min(i - at - 1, LONGEST_WINDOW)][state]
            state, factor, added = self.table[state][symbol]
            total += weight * factor + added
            if symbol == BOUNDARY and total:
                out.append(total)
                total = 0.0
            at = i
        trim(codes, self.most)
        return out + [total] if total else out

    def weight(self, text: str) -> float:
        return sum(self.clauses(text))


@dataclass
class Model:
    weights: dict[str, float]
    intercept: float = -3.0
    slope: float = 3.0

    def probability(self, weight: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + self.slope * np.log1p(weight))))


def lexicon(sample: DataFrame) -> dict[str, float]:
    """Log-odds of words and word beginnings that the labels show to be toxic; a prior for insults seldom seen.

    A feature enters with a G statistic of 2 ln(10 n) or more for n rows, which chance alone seldom reaches among so many
    features; the table stays small whatever the vocabulary.
    """
    counts = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = dict.fromkeys(INSULTS, PRIOR_WEIGHT)
    if not counts.get(0) or not counts.get(1):
        return out
    n0, n1 = counts[0], counts[1]
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    starts = [F.transform(F.filter("words", lambda w, n=n: F.length(w) > n), lambda w, n=n: F.concat(F.lit("^"), F.substring(w, 1, n))) for n in PREFIXES]
    seen = sample.select("label", words.alias("words")).select("label", F.explode(F.array_distinct(F.concat("words", *starts))).alias("feature"))
    totals = seen.groupBy("feature").agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("n"))
    p, n = F.col("p"), F.col("n") - F.col("p")
    share = n1 / (n0 + n1)

    def part(x: Column, expected: Column) -> Column:
        return F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)

    evidence = 2 * (part(p, F.col("n") * share) + part(n, F.col("n") * (1 - share)))
    odds = F.log((p + 0.5) / (n1 + 1)) - F.log((n + 0.5) / (n0 + 1))
    known = F.col("feature").isin(INSULTS) & (F.col("n") >= 5)
    rows = totals.select("feature", odds.alias("odds"), evidence.alias("g"), known.alias("known"))
    for r in rows.filter(f"known OR (g >= {2 * math.log(10 * (n0 + n1))} AND odds > 1.5)").collect():
        out[r.feature] = min(r.odds, 6.0)
    return {w: x for w, x in out.items() if x > 0.5}


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Intercept and slope by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(h, a.T @ (weight * (y - p)) - ridge * b)
        b += step
        if abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 3, held: int = 1, most: dict[int, int] | None = None) -> Model:
    """Learns from at most LABELLED rows per label outside the held-out ones; without both labels the general words are used."""
    sample = stored(labelled_sample(docs, labels, label, modulus, held, most or LABELLED), "toxicity")
    weights = lexicon(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(weights)
        for batch in batches:
            x = pa.array([s.weight(t) for t in texts_of(batch.column(0))], pa.float64())
            yield pa.RecordBatch.from_arrays([x, batch.column(1), batch.column(2)], ["x", "y", "w"])

    rows = sample.select("text", "label", "weight").mapInArrow(run, "x double, y int, w double").toPandas().sort_values(["y", "x"])
    if rows.y.nunique() < 2:
        return Model(weights)
    intercept, slope = logistic(np.log1p(rows.x.to_numpy()), rows.y.to_numpy(float), rows.w.to_numpy())
    return Model(weights, intercept, max(slope, 0.1))


def probability(text: Column, model: Model) -> Column:
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo_of("toxicity")
        s = Scorer(model.weights)
        for texts in batches:
            yield pd.Series(model.probability(np.array([s.weight(t or "") for t in texts], float)))

    return score(text.cast("string"))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", modulus: int = 3, held: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; the score reads the text only.

    Null and empty texts get the score of a text without matches. A null id is not held out. Repeated rows are repeated, an empty
    table gives no rows, columns other than the two named are ignored.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), probability(F.col(text_col), model).alias("score"))
    return picked.select("doc_id", held_out(F.col("doc_id"), modulus, held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, with all their columns, whose score is below the threshold."""
    return docs.filter(probability(F.col(text_col), model) < threshold)
