"""Joins that avoid all pairs, against all pairs on random rows with hot words."""

import random
from collections import Counter
from itertools import combinations

import pytest

from clausemill.operators import graph_build as gb
from clausemill.operators import mapping as mp
from clausemill.operators import quality as ql
from clausemill.operators import terms as tm

SECTIONS = "doc string, node_id string, title string"


def strongest(rows, k):
    links = []
    for (d1, a, s), (d2, b, t) in combinations(sorted(rows, key=lambda r: r[1]), 2):
        common = set(s.split()) & set(t.split())
        if d1 != d2 and common:
            links.append((-len(common), a, b, min(common)))
    return [(a, b, -n, w) for n, a, b, w in sorted(links)[:k]]


def linked(spark, rows, k):
    return [tuple(r)[:4] for r in mp.shared_term_links(spark.createDataFrame(rows, SECTIONS), "[a-z]+", k).collect()]


def test_shared_terms_keep_weak_pairs(spark):
    rows = [("A", "a", "xx"), ("B", "b", "yy"), ("D", "d", "xx yy"), ("E", "e", "xx yy")]
    assert linked(spark, rows, 50) == strongest(rows, 50)
    assert ("d", "e", 2, "xx") in linked(spark, rows, 50)


@pytest.mark.parametrize("seed, k", [(1, 5), (2, 50), (3, 400)])
def test_strongest_overlaps_equal_all_pairs(spark, seed, k):
    rnd = random.Random(seed)
    words = [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(f"d{rnd.randint(0, 4)}", f"n{i:03}", " ".join(["all", *rnd.sample(words, rnd.randint(0, 6))])) for i in range(70)]
    rows += [("d0", f"r{i:02}", "all same title here") for i in range(15)] + [(f"d{i % 3}", f"s{i:02}", "all same title here") for i in range(9)]
    rows += [("d9", "none", "")]
    assert linked(spark, rows, k) == strongest(rows, k)


def test_isolated_nodes_equal_all_pairs(spark):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(25)]
    nodes = [(f"n{i:03}", f"d{rnd.randint(0, 5)}", rnd.choice(["section", "keyword", "document"]), " ".join(["every", *rnd.sample(words, rnd.randint(0, 5))])) for i in range(90)]
    nodes += [("z1", "own", "single", ""), ("z2", "own", "single", ""), ("zhub", "own", "other", ""), ("lone", "nowhere", "none", "")]
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(0, 60, 2)]
    df = spark.createDataFrame(nodes, "id string, doc string, type string, label string")
    e = spark.createDataFrame(edges, "src string, dst string")
    for least in (1, 9):
        got = sorted(tuple(r) for r in gb.attach_isolated(df, e, least=least).collect())
        used, want = {x for p in edges for x in p}, []
        for i, d, t, label in nodes:
            if i in used:
                continue
            scored = sorted((-(5 * (d == d2) + 3 * (t == t2) + 2 * len(set(label.split()) & set(l2.split()))), j, t2) for j, d2, t2, l2 in nodes if j != i)
            best = [r for r in scored if -r[0] >= least][:3]
            for s, j, t2 in best:
                want.append((i, j, "belongs_to" if (t, t2) == ("section", "document") else "related_to" if t == "keyword" else "cross_references", -s))
            if not best:
                hub = min((not ("hub" in j or t2 == "document"), j) for j, d2, t2, _ in nodes if d2 == d)[1]
                want += [(i, hub, "belongs_to", 0)] if hub != i else []
        assert got == sorted(want)
    assert any(r[1] == "zhub" and r[3] == 0 for r in got)


def test_a_word_in_every_label_joins_no_one_with_all(spark):
    """With nothing else in common than one word, a node has as many candidates as it wants, not all nodes."""
    n = 400
    df = spark.createDataFrame([(f"n{i:03}", f"d{i}", f"t{i}", "every") for i in range(n)], "id string, doc string, type string, label string")
    none = spark.createDataFrame([], "src string, dst string")
    joins = []
    plain = gb.top_per
    gb.top_per = lambda df, keys, *a: (joins.append(df) if keys == ["iso"] else None, plain(df, keys, *a))[1]
    try:
        got = gb.attach_isolated(df, none).collect()
    finally:
        gb.top_per = plain
    assert len(got) == 3 * n and max(j.count() for j in joins) <= 5 * n


@pytest.mark.parametrize("run", [50, 1 << 20])
def test_pair_counters_are_exact(spark, monkeypatch, run):
    monkeypatch.setattr(tm, "RUN", run)
    rnd = random.Random(5)
    names = [f"t{i}" for i in range(60)]
    sections = {f"s{i}": rnd.sample(names, rnd.randint(0, 12)) for i in range(80)}
    if run > 50:
        sections["long"] = [f"u{i}" for i in range(2500)]
    rows = [(s, t) for s, ts in sections.items() for t in ts] * 2
    occ = spark.createDataFrame(rows, "node_id string, term string")
    terms = spark.createDataFrame([(t,) for t in names[:50]] + [(f"u{i}",) for i in range(2500)], "term string")
    allowed = {*names[:50], *(f"u{i}" for i in range(2500))}
    want = Counter(p for ts in sections.values() if len(ts) < 100 for a, b in combinations(sorted(set(ts) & allowed), 2) for p in ((a, b), (b, a)))
    for least in (2, 4):
        got = {(r.t1, r.t2): r.n for r in tm.cooccurrence(occ, terms, least).collect()}
        assert got == {p: n for p, n in want.items() if n >= least}
    assert tm.cooccurrence(occ.limit(0), terms).collect() == []


def test_contained_terms_equal_all_pairs(spark, monkeypatch):
    rnd = random.Random(6)
    letters = "abc"
    texts = ["".join(rnd.choice(letters + " ") for _ in range(rnd.randint(0, 40))) for _ in range(60)] + ["ABcabc", None, ""]
    keys = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9))) for _ in range(150)})
    t = spark.createDataFrame([(x,) for x in texts], "text string")
    k = spark.createDataFrame([(x,) for x in [*keys, "", "abca"]], "key string")
    want = {x for x in keys + ["abca"] if any(x in (y or "").lower() for y in texts)}
    for most in (20_000, 3):
        monkeypatch.setattr(ql, "SEED_LIST", most)
        assert {r.key for r in ql.contained_terms(k, t).collect()} == want
    assert ql.contained_terms(k.limit(0), t).collect() == [] and ql.contained_terms(k, t.limit(0)).collect() == []


@pytest.mark.parametrize("limit", [None, 4])
def test_paths_equal_all_simple_paths(spark, limit):
    from clausemill.operators import graph_query as gq

    rnd = random.Random(9)
    edges = {tuple(sorted(rnd.sample(range(12), 2))) for _ in range(20)} | {(0, i) for i in range(1, 6)}
    around = {i: {b for a, b in edges if a == i} | {a for a, b in edges if b == i} for i in range(12)}
    pairs = [(0, 7), (3, 9), (1, 2), (4, 4), (11, 0)]
    want = []
    for s, t in pairs:
        todo, found = [[s]], []
        while todo:
            p = todo.pop()
            if p[-1] == t and len(p) > 1:
                found.append(p)
            elif len(p) < 6:
                todo += [[*p, n] for n in around[p[-1]] if n not in p]
        texts = sorted((len(p), ">".join(f"n{i}" for i in p)) for p in found if s != t)
        want += [(f"n{s}", f"n{t}", n, x) for n, x in texts[:limit]]
    e = spark.createDataFrame([(f"n{a}", f"n{b}", "x") for a, b in edges], "src string, dst string, type string")
    p = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "source string, target string")
    got = [(r.source, r.target, r.length, r.path) for r in gq.paths(p, e, 6, limit).collect()]
    assert sorted(got) == sorted(want)


def test_steps_of_many_seeds(spark):
    """More seeds than one number has marks for."""
    from clausemill.operators import graph_query as gq

    rnd = random.Random(10)
    edges = [tuple(rnd.sample(range(200), 2)) for _ in range(180)] + [(0, i) for i in range(1, 30)]
    around = {i: {b for a, b in edges if a == i} | {a for a, b in edges if b == i} for i in range(300)}
    want = set()
    for s in [*range(150), 250]:
        seen, last = {s}, {s}
        for d in (1, 2, 3):
            last = {n for x in last for n in around[x]} - seen
            seen |= last
            want |= {(s, n, d) for n in last}
    e = spark.createDataFrame(edges, "src long, dst long")
    seeds = spark.createDataFrame([(i,) for i in [*range(150), 250, 3]], "seed long")
    assert {tuple(r) for r in gq.khop(seeds, e, 3).collect()} == want
    assert {tuple(r) for r in gq.khop(seeds.filter("seed = 250"), e, 2, with_seed=True).collect()} == {(250, 250, 0)}
