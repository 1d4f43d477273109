"""Dart signatures against exact weighted similarity, classes against brute force over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausemill.llm import near_dups as nd


def make(rng, n):
    return " ".join(rng.choice([f"w{i}" for i in range(400)], n))


def edited(rng, text, share):
    words = text.split()
    for i in rng.choice(len(words), int(len(words) * share), replace=False):
        words[i] = f"e{rng.integers(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("share", [0.0, 0.01, 0.03, 0.1])
def test_signature_agreement(share):
    rng = np.random.default_rng(5)
    hashes = nd.WordHashes()
    gaps = []
    for n in (30, 300, 3000):
        a = make(rng, n)
        x, y = nd.shingles(a + " " + a[: n // 2], hashes), nd.shingles(edited(rng, a, share) + " " + a[: n // 2], hashes)
        s = nd.signatures([x, y], 400)
        assert (s != nd.EMPTY).all()
        gaps.append(abs((s[0] == s[1]).mean() - nd.similarity(x, y)))
    assert max(gaps) < 0.1


def test_weights_count():
    x = np.array([1, 2, 3], np.uint64)
    a, b = (x, np.array([1.0, 4.0, 2.5])), (x, np.array([2.0, 1.0, 2.5]))
    s = nd.signatures([a, b], 2000)
    assert abs((s[0] == s[1]).mean() - 4.5 / 8.5) < 0.05


def brute(rows):
    """class of every row by all pairs."""
    hashes = nd.WordHashes()
    texts = sorted({r.text or "" for r in rows})
    sets = [nd.shingles(t, hashes) for t in texts]
    root = list(range(len(texts)))

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if nd.similarity(sets[i], sets[j]) >= 0.8:
                root[up(i)] = up(j)
    at = {t: up(i) for i, t in enumerate(texts)}
    own = {}
    for r in rows:
        own.setdefault(at[r.text or ""], []).append(r.doc_id)
    out = []
    for r in rows:
        ids = own[at[r.text or ""]]
        out.append((r.doc_id, min((i for i in ids if i is not None), default=None), len(ids)))
    return sorted(out, key=str)


def docs_with_groups(spark, odd):
    rng = np.random.default_rng(3)
    rows = [(100 + i, make(rng, int(rng.integers(1, 300)))) for i in range(60)]
    base = make(rng, 200)
    rows += [(1000 + i, edited(rng, base, 0.005 * (i % 4))) for i in range(150)]  # a crowded group of near copies
    rows += [(2000, base), (2001, base), (2001, base)]
    step = make(rng, 150)
    for i in range(8):  # a chain
        rows.append((3000 + i, step))
        step = edited(rng, step, 0.02)
    return spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))


def test_classes(spark, odd, none):
    df = docs_with_groups(spark, odd).withColumn("class_id", F.lit("clash"))
    rows = df.collect()
    got = nd.near_dup_classes(df).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    kept = nd.keep_one(df)
    assert kept.columns == df.columns
    left = [(r.doc_id, r.text) for r in kept.collect()]
    classes = {}
    for d, c, n in brute(rows):
        classes.setdefault((c, n), d)
    # one row per class; the two classes of rows without an id are told apart by their text
    assert len(left) == len(set(left)) == len({(c, n, d if c is None else 0) for d, c, n in brute(rows)}) + 0
    assert {d for d, _ in left if d is not None} == {c for _, c, _ in brute(rows) if c is not None}
    assert nd.near_dup_classes(none).count() == 0 and nd.keep_one(none).count() == 0


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(map(tuple, nd.near_dup_classes(df).collect()), key=str) == brute(df.collect())


def far_from_pivots(rng, n):
    """A template with fields: copies of a few fillings, most fillings near no other one."""
    base = make(rng, 300).split()
    rows = []
    for i in range(n):
        words = list(base)
        at = rng.choice(280, 9, replace=False)
        for k in at:
            words[k] = f"f{rng.integers(10**6)}"
        rows.append((50_000 + 2 * i, " ".join(words)))
        words[290] = "other"
        rows.append((50_001 + 2 * i, " ".join(words)))
    return rows


def test_template_family(spark):
    """No pair of a large bucket is left out when a round links nothing."""
    rng = np.random.default_rng(11)
    df = spark.createDataFrame(far_from_pivots(rng, 120), "doc_id long, text string")
    assert sorted(map(tuple, nd.near_dup_classes(df).collect()), key=str) == brute(df.collect())


def drifting(rng, groups, n, step):
    """Chains of copies: every text is near the ones before and after it, the ends have little in common."""
    rows = []
    for g in range(groups):
        text = make(rng, 240)
        for i in range(n):
            rows.append((10_000 * (g + 1) + i, text))
            text = edited(rng, text, step)
    return rows


def test_drifting_copies(spark):
    """Copies that drift by the hundred: links between texts that did and did not link to a pivot."""
    rng = np.random.default_rng(11)
    df = spark.createDataFrame(drifting(rng, 2, 250, 0.005), "doc_id long, text string")
    assert sorted(map(tuple, nd.near_dup_classes(df).collect()), key=str) == brute(df.collect())


def test_one_large_bucket(spark):
    """One bucket of 120 texts: a pair that no pivot is near, and p ~ x ~ y where p is a pivot that is not near y."""
    rng = np.random.default_rng(2)
    p = make(rng, 240)
    x = p.split()
    x[60:72] = ["x"] * 12
    y = list(x)
    y[160:178] = ["y"] * 18
    a = make(rng, 200)
    named = {"p": p, "x": " ".join(x), "y": " ".join(y), "a": a, "b": edited(rng, a, 0.01)} | {f"f{i}": make(rng, 200) for i in range(115)}
    sets = {k: nd.shingles(t, nd.WordHashes()) for k, t in named.items()}
    near = {(i, j) for i in named for j in named if i < j and nd.similarity(sets[i], sets[j]) >= 0.8}
    assert near == {("p", "x"), ("x", "y"), ("a", "b")}
    bands = {"p": [1, 2, 3], "f0": [1, 2], "f1": [1, 3]}
    rows = [(bytearray(k.encode()), i, bands.get(k, [1]), int(sets[k][1].sum())) for i, k in enumerate(named)]
    reps = spark.createDataFrame(rows, "key binary, id long, bands array<long>, size long")
    texts = spark.createDataFrame([(r[0], r[1], t) for r, t in zip(rows, named.values())], "key binary, id long, text string")
    got = {(bytes(r.a).decode(), bytes(r.b).decode()) for r in nd.near_links(reps, texts).collect()}
    assert got == near


def test_large_buckets_leave_no_pair_out(spark, monkeypatch):
    """Near texts of a crowded bucket that share no other band; its parts are smaller than the bucket."""
    monkeypatch.setattr(nd, "PART", 25)
    rng = np.random.default_rng(7)
    named = {}
    for g in range(12):
        text = make(rng, 200)
        named |= {f"{g:02}a": text, f"{g:02}b": edited(rng, text, 0.01)}
    named |= {f"f{i:03}": make(rng, 200) for i in range(100)}
    sets = {k: nd.shingles(t, nd.WordHashes()) for k, t in named.items()}
    # The crowded band is the first one; each text's other bands are its own.
    rows = [(bytearray(k.encode()), i, [1, 1000 + 2 * i, 1001 + 2 * i], int(sets[k][1].sum())) for i, k in enumerate(named)]
    reps = spark.createDataFrame(rows, "key binary, id long, bands array<long>, size long")
    texts = spark.createDataFrame([(r[0], r[1], t) for r, t in zip(rows, named.values())], "key binary, id long, text string")
    links, roots = nd.linked(reps, texts)
    want = {(f"{g:02}a", f"{g:02}b") for g in range(12)}
    assert {(bytes(r.a).decode(), bytes(r.b).decode()) for r in links.collect()} == want
    assert {(bytes(r.key).decode(), bytes(r.root).decode()) for r in roots.collect()} == {(x, a) for a, b in want for x in (a, b)}


def test_postings_count_like_similarity():
    rng = np.random.default_rng(4)
    hashes = nd.WordHashes()
    base = make(rng, 60)
    texts = [base, edited(rng, base, 0.02), base + " " + base, "w1 w1 w1 w1 w1 w1 w1 w1", "w1 w1 w1 w1 w1 w1 w1", "", make(rng, 40)]
    sets = [nd.shingles(t, hashes) for t in texts]
    postings = nd.Postings(sets)
    for least in (0.3, 0.75, 0.8, 1.0):
        for s in sets:
            assert postings.alike(s, least).tolist() == [nd.similarity(t, s) >= least for t in sets]


def test_template_makes_no_row_per_pair(spark, monkeypatch):
    """Fillings of one template, alike enough to be compared but not near: rows that are stored grow with the texts, not with pairs."""
    rng = np.random.default_rng(13)
    base = make(rng, 300).split()
    rows = []
    for i in range(200):
        words = list(base)
        for k in rng.choice(280, 6, replace=False):
            words[k] = f"f{rng.integers(10**6)}"
        rows.append((i, " ".join(words)))
        if i % 30 == 0:
            words[290] = "other"
            rows.append((1000 + i, " ".join(words)))
    sizes = {}
    plain = nd.stored

    def counting(df, name):
        out = plain(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(nd, "stored", counting)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, nd.near_dup_classes(df).collect()), key=str) == brute(df.collect())
    assert max(sizes.values()) <= nd.BANDS * len(rows), sizes
