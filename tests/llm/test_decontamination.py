"""Approximate item search against a full edit-distance table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausemill.llm import decontamination as dc


def least_distance(pattern, text):
    row = list(range(len(pattern) + 1))
    least = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != c)))
        row = new
        least = min(least, row[-1])
    return least


@pytest.mark.parametrize("seed", range(6))
def test_bit_parallel(seed):
    rng = np.random.default_rng(seed)
    for _ in range(20):
        p, t = ("".join(rng.choice(list("abc"), n)) for n in (int(rng.integers(1, 90)), int(rng.integers(0, 150))))
        assert dc.Pattern(p).best(t)[0] == least_distance(p, t)


def test_find(spark, odd, none):
    rng = np.random.default_rng(1)
    words = [f"{a}{b}{c}" for a in "kmt" for b in "aeo" for c in "rns"]

    def make(n):
        return " ".join(rng.choice(words, n))

    items = [(i, make(int(rng.integers(1, 60)))) for i in range(25)] + [(30, None), (31, "!!"), (32, ""), (0, "Again, the same id."), (None, make(20))]
    docs = []
    for i in range(60):
        own = [make(int(rng.integers(0, 40)))]
        for _ in range(int(rng.integers(0, 3))):
            text = list(items[int(rng.integers(0, 25))][1])
            for _ in range(int(rng.integers(0, 2 + len(text) // 12))):
                at = int(rng.integers(0, len(text)))
                text[at] = ["", "x", text[at] + "y"][int(rng.integers(0, 3))]
            own += ["".join(text), make(3)]
        docs.append((i, " ".join(own).title()))
    df = spark.createDataFrame(docs + docs[:2] + [(None, docs[0][1])], "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    df = df.withColumn("item_id", F.lit("clash"))
    tests = spark.createDataFrame(items, "item_id long, text string")
    want, clean = [], []
    for r in df.collect():
        t = dc.normal(r.text or "")
        tried = [(i, least_distance(x, t), len(x)) for i, x in ((i, dc.normal(x or "")) for i, x in items) if x and len(t) < 5000]
        hits = [(r.doc_id, i, d) for i, d, n in tried if d <= int(0.05 * n)]
        want += hits
        clean += [] if hits else [(r.doc_id, r.text)]
    got = [(r.doc_id, r.item_id, r.distance) for r in dc.find_items(df, tests).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 40
    kept = dc.decontaminate(df, tests)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(clean, key=str)
    assert dc.find_items(none, tests).count() == 0 and dc.find_items(df, tests.limit(0)).count() == 0
    assert dc.decontaminate(df, tests.limit(0)).count() == df.count()


def test_text_ids(spark):
    """Items may be named by text; batches without a hit keep the type."""
    docs = spark.createDataFrame([(1, "nothing"), (2, "one two three four five")], "doc_id long, text string").repartition(2, "doc_id")
    items = spark.createDataFrame([("q1", "Two, three four")], "name string, body string")
    got = dc.find_items(docs, items, item_id="name", item_text="body").collect()
    assert [tuple(r) for r in got] == [(2, "q1", 0, 4, 18)]
