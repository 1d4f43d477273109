"""Steps that grew faster than their tables, against plain all-pairs versions on rows of their own."""

import random

import numpy as np
from pyspark.sql import functions as F

from clausemill.catalog.base import Tables
from clausemill.functions import scale
from clausemill.operators import graph_build as gb
from clausemill.operators import graph_query as gq
from clausemill.operators import index as ix
from clausemill.operators import pruned as pr
from clausemill.operators import rerank as rr
from clausemill.operators import structure as st


def test_best_documents_equal_all_scores(spark, monkeypatch):
    """Repeated and null ids, one pass and several, token lists and postings."""
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(["the", *rnd.choices(words, k=rnd.randint(0, 12))])) for i in range(150)]
    docs += [(7, "the w1 w2"), (None, "w3 w4"), (None, "w3"), (900, None), (901, "")]
    q = spark.createDataFrame([(i, " ".join(rnd.choices(["the", "none", *words], k=4))) for i in range(60)] + [(3, "w1"), (None, "w3 w5")], "query_id long, query string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    rows = lambda df: sorted(((r.query_id, r.doc_id, round(r.score, 6), r["rank"]) for r in df.collect()), key=str)
    for tf in ("binary", "raw"):
        index = ix.build_index(d, tf=tf)
        want = rows(ix.ranked(ix.bm25_scores(ix.query_terms(q), index), 3))
        for weights, cells in ((250_000, 2_000_000), (120, 100)):
            monkeypatch.setattr(ix, "WEIGHT_ROWS", weights)
            monkeypatch.setattr(ix, "CELLS", cells)
            assert rows(ix.top_documents(ix.query_terms(q), index, 3)) == want
        assert rows(ix.top_documents(ix.query_terms(q), ix.TextIndex(index.postings, index.terms, index.corpus), 3)) == want


def test_a_task_passes_on_k_rows_a_query(spark, monkeypatch):
    """A word of all documents makes no row for every document."""
    sent = []
    plain = ix.ranked
    monkeypatch.setattr(ix, "ranked", lambda df, k: (sent.append(df), plain(df, k))[1])
    d = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("the same").alias("text")).repartition(4)
    q = spark.createDataFrame([(i, "the same") for i in range(5)], "query_id long, query string")
    assert [r.doc_id for r in ix.bm25_topk(q, ix.build_index(d), 3).filter("query_id = 4").orderBy("rank").collect()] == [0, 1, 2]
    assert sent[-1].count() <= 3 * 5 * 8


def test_pruned_search_looks_at_few_pairs_and_finds_the_best():
    """F1, F2: every pair of a document and a query with a common term was scored."""
    rng = np.random.default_rng(7)
    docs, terms, n, k = 3000, 400, 80, 3
    often = 1 / np.arange(1, terms + 1)
    has = rng.random((docs, terms)) < often
    part = np.where(has, rng.choice([0.4, 1.0, 1.7], (docs, 1)) * rng.choice([1.0, 0.5, 0.9], (docs, terms)), 0.0)
    weight = np.zeros((n, terms))
    for q in range(n):
        weight[q, rng.choice(terms, rng.integers(1, 15), replace=False, p=often / often.sum())] = 1
    weight *= -np.log(often) + 0.05
    weight[5] *= -1
    weight[6, :3] = -0.3
    row, term = np.nonzero(part)
    owner, asked = np.nonzero(weight)
    queries = pr.Queries(owner, asked, weight[owner, asked], n)
    s = pr.Slice(row, term, part[row, term], docs, terms)
    every = np.round(weight @ part.T, 6)
    seen = []
    plain = pr.added
    for least in (np.zeros(n), np.maximum(np.sort(every, axis=1)[:, -k], 0)):
        found = {q: {} for q in range(n)}
        try:
            pr.added = lambda *a: (seen.append(len((r := plain(*a))[0])), r)[1]
            for who, doc, score in pr.best_pairs(queries, s, k, least, 500):
                for q, d, x in zip(who.tolist(), s.row[doc].tolist(), score.tolist()):
                    assert d not in found[q]
                    found[q][d] = round(x, 6)
        finally:
            pr.added = plain
        for q in range(n):
            want = [(-every[q, d], d) for d in range(docs) if every[q, d] > 0]
            assert np.allclose(sorted((-x, d) for d, x in found[q].items())[:k], sorted(want)[:k], atol=2e-6)
        if least.any():
            assert sum(seen) < np.count_nonzero((weight != 0).astype(int) @ has.T) / 4
        seen.clear()


def test_a_large_batch_is_bounded_by_a_share_of_the_documents(spark, monkeypatch):
    """F1, F2: a task passes on few rows of a query, and the rows are those of all scores."""
    for name, value in (("BOUNDED_ROWS", 1), ("BOUNDED_DOCS", 1), ("SHARE", 3), ("WEIGHT_ROWS", 60)):
        monkeypatch.setattr(ix, name, value)
    monkeypatch.setattr(pr, "SLICE_POSTINGS", 150)
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    d = spark.createDataFrame([(i, " ".join(rnd.choices(words, k=rnd.randint(0, 12)))) for i in range(300)] + [(7, "w1 w2"), (None, "w3"), (900, None)], "doc_id long, text string")
    q = spark.createDataFrame([(i, " ".join(rnd.choices([*words, "none"], k=rnd.randint(1, 4)))) for i in range(40)] + [(None, "w3 w5")], "query_id long, query string")
    rows = lambda df: sorted(((r.query_id, r.doc_id, round(r.score, 6), r["rank"]) for r in df.collect()), key=str)
    for tf in ("binary", "raw"):
        index = ix.build_index(d, tf=tf)
        assert rows(ix.bm25_topk(q, index, 3)) == rows(ix.ranked(ix.bm25_scores(ix.query_terms(q), index), 3))


def test_many_vector_queries_meet_every_slice_once(spark, monkeypatch):
    monkeypatch.setattr(ix, "CELLS", 500)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    q = df.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    score = np.round(unit[::5] @ unit.T, 6)
    want = sorted((5 * i, int(j)) for i, s in enumerate(score) for j in np.lexsort((np.arange(300), -s))[:4])
    for block in (4096, 7):  # all queries at once, and slices of 40 that meet a stream of queries
        got = ix.vector_topk(q, df, 4, block=block, slice_rows=40)
        assert sorted((r.query_id, r.vec_id) for r in got.collect()) == want


def test_containment_meets_only_words_inside(spark):
    rnd = random.Random(3)
    texts = [(i, "".join(rnd.choice("ab ") for _ in range(rnd.randint(0, 14)))) for i in range(60)] + [(5, "abab"), (5, "abab"), (99, None)]
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 9))) for _ in range(80)}) + ["", "abab"]
    t, w = spark.createDataFrame(texts, "_n long, t string"), spark.createDataFrame([(x,) for x in words], "w string")
    want = sorted((i, x, y) for i, x in texts if x is not None for y in words if y and y in x)
    got = scale.containment_join(t, "t", w, "w")
    assert got.columns == ["_n", "t", "w"] and sorted(map(tuple, got.collect())) == want


def test_network_of_more_queries_than_bits(spark):
    rnd = random.Random(4)
    labels = {f"n{i}": " ".join(rnd.choices(["alpha", "beta", "gamma", "delta"], k=2)) for i in range(40)}
    edges = [(f"n{rnd.randint(0, 39)}", f"n{rnd.randint(0, 39)}", "x") for _ in range(50)]
    asked = {i: rnd.choice(["alp", "eta", "nothing", "delta gam", "mm"]) for i in range(150)}
    around = {}
    for a, b, _ in edges:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    hit = {i: {n for n, x in labels.items() if any(w in x for w in q.split())} for i, q in asked.items()}
    want = {(i, n) for i, own in hit.items() for n in own.union(*(around.get(x, set()) for x in own))}
    nodes = spark.createDataFrame([(n, "t", x) for n, x in labels.items()], "id string, type string, label string")
    found, _ = gq.filter_network(spark.createDataFrame([*asked.items()], "query_id long, query string"), nodes, spark.createDataFrame(edges, "src string, dst string, type string"))
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_ranges_of_markers_with_and_without_blanks(spark):
    rnd = random.Random(5)
    words = ["ab", "abc", "bca", "x.", "Part"]
    pages = [(f"d{rnd.randint(0, 2)}", rnd.randint(0, 150), " ".join(rnd.choices(words, k=rnd.randint(0, 3)))) for _ in range(80)] + [("d0", 3, None)]
    subs = [(f"d{rnd.randint(0, 3)}", f"s{i}", rnd.randint(0, 140), rnd.choice(["ab", "bc", "", "ab x", "a", "Part ab", None, " ", "zz"])) for i in range(70)]
    want = set()
    for d, n, h, m in subs:
        at = [p for e, p, t in pages if m is not None and t is not None and e == d and h - 5 <= p <= h + 50 and m in t]
        want |= {(d, n, min(at))} if at else set()
    s = spark.createDataFrame(subs, "doc string, name string, hint long, marker string")
    got = st.locate_ranges(s, spark.createDataFrame(pages, "doc string, page long, text string"))
    assert {(r.doc, r.name, r.start) for r in got.collect()} == want


def test_markers_of_a_word_are_looked_up_once(spark, monkeypatch):
    """a word met the markers once for every text that holds it."""
    met = []
    plain = st.containment_join
    monkeypatch.setattr(st, "containment_join", lambda texts, *a: (met.append(texts.count()), plain(texts, *a))[1])
    pages = spark.createDataFrame([(f"d{i % 3}", i, "the same part") for i in range(60)], "doc string, page long, text string")
    subs = spark.createDataFrame([(f"d{i}", f"s{i}", 10, "art") for i in range(3)], "doc string, name string, hint long, marker string")
    assert {(r.doc, r.name, r.start) for r in st.locate_ranges(subs, pages).collect()} == {("d0", "s0", 6), ("d1", "s1", 7), ("d2", "s2", 5)}
    assert met == [3]


def test_substrings_of_names_are_not_aggregated(spark):
    """Only names are grouped; their substrings stream into the join."""
    s = spark.createDataFrame([("doc_abc_r1",), ("abc",)], "source string")
    c = spark.createDataFrame([("ABC", "t")], "id string, title string")
    out = rr.match_catalog(s, c)
    assert {(r.source, r.stage, r.id) for r in out.collect()} == {("abc", 1, "ABC"), ("doc_abc_r1", 2, "ABC")}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Aggregate" in line and "key#" in line.split("]")[0] for line in plan.split("\n"))


def test_files_make_as_many_tasks_as_they_need(spark):
    df = spark.range(10).coalesce(1)
    assert scale.spread_out(df, 100 * scale.SCAN_BYTES).rdd.getNumPartitions() == 100


def test_isolated_nodes_are_scored_in_blocks(spark, monkeypatch):
    """every group of equal labels meets all others inside tasks; repeated and null rows as by brute force (a null label has no words)."""
    monkeypatch.setattr(gb, "BLOCK", 9)
    rng = random.Random(5)
    some = lambda: " ".join(rng.choices(["ax", "bx", "cx", "dx", "ex", "fx"], k=rng.randint(0, 4)))
    rows = [(f"n{i:02d}", rng.choice(["d", "e", None]), rng.choice(["t", "u", None]), some()) for i in range(40)]
    rows += [rows[3], ("n04", "e", "u", "ax zz"), (None, "d", "t", "ax bx"), ("n90", "d", "t", None)]
    linked = {"n01", "n07"}
    nodes = spark.createDataFrame(rows, "id string, doc string, type string, label string")
    edges = spark.createDataFrame([("n01", "n07")], "src string, dst string")

    def want(least):
        out = []
        for iso in {r[0] for r in rows} - linked - {None}:
            pairs = []
            for _, d, t, label in [r for r in rows if r[0] == iso]:
                for i, doc, kind, other in rows:
                    if i not in (None, iso):
                        shared = set((label or "").split()) & set((other or "").split())
                        pairs.append((-(5 * (d is not None and d == doc) + 3 * (t is not None and t == kind) + 2 * len(shared)), i))
            out += [(iso, i, -s) for s, i in sorted(p for p in pairs if -p[0] >= least)[:3]]
        return sorted(out)

    for least in (1, 6, 11):
        got = gb.attach_isolated(nodes, edges, least=least).filter("type <> 'belongs_to'").select("src", "dst", "score")
        assert sorted(map(tuple, got.collect())) == want(least)


def test_shuffles_start_with_more_parts_over_larger_tables(spark, tmp_path, monkeypatch):
    """With a fixed number of parts, what a task of a shuffle holds grew with the table."""
    spark.range(2000).selectExpr("id", "md5(string(id)) text").write.parquet(f"{tmp_path}/events.parquet")
    held = spark.conf.get(scale.FIRST_PARTS, None)
    try:
        spark.conf.unset(scale.FIRST_PARTS)
        Tables(spark, str(tmp_path))("events")
        assert spark.conf.get(scale.FIRST_PARTS, None) is None  # small: the session's own number
        monkeypatch.setattr(scale, "SCAN_BYTES", 1000)
        rows = Tables(spark, str(tmp_path))("events").groupBy("text").count()
        want = -(-scale.file_bytes(spark, f"{tmp_path}/events.parquet") // 1000)
        assert want > 8 and "hashpartitioning(text#" in (plan := rows._jdf.queryExecution().executedPlan().toString()) and f", {want})" in plan
    finally:
        spark.conf.set(scale.FIRST_PARTS, held) if held else spark.conf.unset(scale.FIRST_PARTS)


def test_texts_in_many_files_are_not_shuffled_to_be_searched(spark, tmp_path):
    """an index and vectors are built where texts are read; only texts in fewer files than cores are spread first."""
    docs = spark.range(3000).selectExpr("id doc_id", "repeat(md5(string(id)), 20) text")
    for files in (40, 1):
        docs.repartition(files).write.parquet(f"{tmp_path}/{files}/documents.parquet")
        rows = Tables(spark, f"{tmp_path}/{files}").scanned_docs()
        assert rows.count() == 3000 and rows.columns == ["doc_id", "text"]
        assert ("Exchange" in rows._jdf.queryExecution().executedPlan().toString()) == (files == 1)


def test_refines_pairs_are_dealt_into_blocks(spark, monkeypatch):
    """A number with many rows on both sides: its pairs are made by many tasks, however few bytes its rows have. Nulls, repeated rows."""
    rows = [("a", f"1.{i}", f"n{i}") for i in range(300)] + [("a", "1", f"c{i}") for i in range(100)] + [("b", "2.1.4", "x"), ("b", "2.1", "y"), ("b", "2", "z")]
    rows += [("b", "2", "z"), ("b", "2", None), ("b", "2.1.4", None), (None, "2", "p"), (None, "2.3", "q"), ("b", None, "r"), ("a", "", "s"), ("c", "7.1", "t")]
    want = sorted([(a[2], b[2]) for a in rows for b in rows if a[0] and a[0] == b[0] and a[1] and b[1] and a[1].startswith(b[1] + ".")], key=str)
    sections = spark.createDataFrame(rows, "doc string, number string, node_id string")
    monkeypatch.setattr(gb, "BLOCK_SIDE", 20)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as over large tables
    try:
        got = gb.refines_edges(sections)
        assert sorted([(r.src, r.dst) for r in got.collect()], key=str) == want
        shares = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert len(shares) >= 30 and max(shares) < 3_000  # of 30,000 pairs of one number
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert gb.refines_edges(sections.limit(0)).count() == 0
