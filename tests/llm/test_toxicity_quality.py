"""Held-out accuracy, and the grammar and the machine against plain restatements."""

import numpy as np
import pytest

from clausemill.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


def auc(y, s):
    return (np.array(s)[np.array(y) == 1][:, None] > np.array(s)[np.array(y) == 0]).mean()


def held_out_rows(spark, scored, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label)
    rows = scored.filter("held_out").join(labels, "doc_id").collect()
    return [r[label] for r in rows], [r.score for r in rows], [r.predicted for r in rows]


def plain_weight(text, weights, kinds):
    """Clause by clause and word by word, with the scopes written out."""
    total = 0.0
    clause = []
    for t in [*toxicity.TOKEN.findall(text.lower()), "."]:
        if t not in ".!?;:\n":
            clause.append(t)
            continue
        for i, w in enumerate(clause):
            back = lambda n, k, i=i: any(kinds.get(x) == k and x not in weights for x in clause[max(0, i - n) : i])
            if w in weights:
                total += weights[w] * (1.3 if back(4, toxicity.TARGET) else 1) * (0.5 if back(3, toxicity.NEGATION) else 1) * (0.6 if back(99, toxicity.REPORT) else 1)
            elif kinds.get(w) == toxicity.THREAT:
                total += toxicity.THREAT_WEIGHT / 2 * (0.3 if back(3, toxicity.NEGATION) else 1) * (0.5 if back(99, toxicity.REPORT) else 1)
            elif kinds.get(w) == toxicity.TARGET and back(4, toxicity.THREAT):
                total += toxicity.THREAT_WEIGHT
        clause = []
    return total


@pytest.mark.parametrize("seed", range(3))
def test_grammar(seed):
    rng = np.random.default_rng(seed)
    weights = {"idiot": 3.0, "scum": 2.0}
    s = toxicity.Scorer(weights)
    words = ["idiot", "scum", "you", "not", "said", "kill", "tree", "river", ".", "\n", "!"]
    for _ in range(200):
        text = " ".join(rng.choice(words, int(rng.integers(0, 30)), p=[0.1, 0.05, 0.1, 0.1, 0.05, 0.1, 0.2, 0.15, 0.05, 0.05, 0.05]))
        assert abs(s.weight(text) - plain_weight(text, weights, s.kinds)) < 1e-9


def test_clauses_not_words():
    s = toxicity.Scorer({"idiot": 3.0})
    assert s.weight("you idiot") > s.weight("an idiot") > s.weight("he said an idiot") > s.weight("he said not an idiot") > 0
    assert s.weight("I will kill you") > s.weight("I will kill time") > s.weight("I will not kill time")
    assert s.weight("") == 0


def test_toxicity_held_out(spark, odd, none):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.learn(docs, labels)
    y, s, p = held_out_rows(spark, toxicity.score(docs, model), "toxic")
    assert auc(y, s) + 0.5 * (np.array(s)[np.array(y) == 1][:, None] == np.array(s)[np.array(y) == 0]).mean() > 0.85
    assert all(t == 1 for t, q in zip(y, p) if q == 1)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.held_out in (True, False) for r in rows)
    assert toxicity.score(none, model).count() == 0
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == toxicity.score(docs, model).filter("predicted = 0").count()
    bare = toxicity.learn(none.select("doc_id", "text"), labels.limit(0))
    assert toxicity.score(odd, bare).count() == odd.count() and bare.weights["idiot"] == toxicity.PRIOR_WEIGHT


def test_linear_time_identity():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=quality.SLOTS), rng.normal(size=(quality.SLOTS, 4)))
    rows = [(rng.choice(quality.SLOTS, n, replace=False), rng.normal(size=n)) for n in (1, 2, 30)]
    want = []
    for i, x in rows:
        pairs = sum(m.v[i[a]] @ m.v[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        want.append(m.bias + m.w[i] @ x + pairs)
    assert np.allclose(m.logits(rows), want)


def test_quality_held_out(spark, odd, none):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    machine = quality.learn(docs, labels)
    y, s, p = held_out_rows(spark, quality.score(docs, machine), "quality")
    assert auc(y, s) > 0.97 and np.mean(np.array(y) == np.array(p)) > 0.93
    rows = quality.score(odd, machine).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(none, machine).count() == 0
    bare = quality.learn(docs, labels.limit(0))
    assert quality.score(odd, bare).count() == odd.count()
