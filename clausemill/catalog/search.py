"""Index, search and fusion queries: documents searched with the benchmark passages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from clausemill.catalog.base import Tables, query, tok
from clausemill.functions import text as tx
from clausemill.functions.scale import stored, stored_root
from clausemill.operators import impact as im
from clausemill.operators import index as ix
from clausemill.operators import terms as tm
from clausemill.operators import vector_index as vx

POSTINGS = f"""bags AS (SELECT doc_id, list_distinct({tok('text')}) AS bag FROM documents),
postings AS (SELECT doc_id, len(bag)::DOUBLE AS dl, unnest(bag) AS term FROM bags),
corpus AS (SELECT count(*) AS n, avg(len(bag)) AS avgdl FROM bags),
vocabulary AS (SELECT term, count(*) AS df FROM postings GROUP BY term)"""

QTERMS = f"qterms AS (SELECT item_id AS query_id, unnest(list_distinct({tok('text')})) AS term FROM benchmark)"

IDF = "ln((n - df + 0.5) / (df + 0.5) + 1)"
PART = f"{IDF} * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / avgdl))"


def scored(source: str, name: str, weight: str = "1") -> str:
    return f"""{name}_sum AS (
  SELECT query_id, doc_id, sum({weight} * {PART}) AS score
  FROM {source} JOIN vocabulary USING (term) JOIN postings USING (term), corpus GROUP BY query_id, doc_id),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM {name}_sum WHERE score > 0)"""


BM25 = f"{POSTINGS},\n{QTERMS},\n{scored('qterms', 'bm25')}"


def synonyms(t: Tables):
    """Dictionary derived from the passages: first phrase -> the two phrases after it."""
    p = tx.phrases(F.col("text"))
    return t("benchmark").select("item_id", p.alias("p")).filter("size(p) >= 3").select(
        F.col("p")[0].alias("term"),
        F.posexplode(F.slice("p", 2, 2)).alias("o", "synonym"),
        "item_id",
    ).select("term", "synonym", (F.col("item_id") * 10 + F.col("o")).alias("ordinal"))


PHR = r"list_distinct(regexp_extract_all(lower({0}), '[a-z][a-z0-9_\-]{{2,}}'))"
# order-keeping distinct for the dictionary
DICT = r"""dict AS (
  SELECT p[1] AS term, p[o + 2] AS synonym, item_id * 10 + o AS ordinal
  FROM (SELECT item_id, list_filter(r, lambda x, i: list_position(r, x) = i) AS p
        FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z][a-z0-9_\-]{2,}') AS r FROM benchmark)),
       (VALUES (0), (1)) v(o)
  WHERE len(p) >= 3)"""


def phr(col: str) -> str:
    return PHR.format(col)


TWO_HOP = """{0}_one AS (SELECT DISTINCT query_id, synonym AS term FROM {1} JOIN dict USING (term)),
{0} AS (SELECT query_id, term FROM {1} UNION SELECT query_id, term FROM {0}_one
        UNION SELECT query_id, synonym FROM {0}_one JOIN dict USING (term))"""

MIXED = (
    DICT
    + f""",
words AS (SELECT item_id AS query_id, text AS query,
            list_transform(regexp_extract_all(text, '[a-zA-Z][a-zA-Z0-9\\-]*'), lambda x: lower(x)) AS w FROM benchmark),
units AS (SELECT DISTINCT query_id, unnest(w) AS term FROM words
          UNION SELECT query_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words),
inner_phrases AS (SELECT DISTINCT query_id, unnest({phr('term')}) AS term FROM units),
{TWO_HOP.format('hop', 'inner_phrases')},
expansion AS (SELECT query_id, term FROM units UNION SELECT query_id, term FROM hop
              UNION SELECT query_id, query FROM words)"""
)


def index(t: Tables) -> ix.TextIndex:
    return ix.build_index(t.scanned_docs())


@query("bm25_topk", f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bm25 WHERE rank <= 3")
def bm25_topk(t):
    return ix.bm25_topk(t.questions(), index(t), 3).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


@query("bm25_blocks", f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bm25 WHERE rank <= 3")
def bm25_blocks(t):
    """The same search over stored posting blocks, most of them skipped."""
    path = f"{stored_root(t.spark)}/blocks-{uuid.uuid4().hex}"
    im.write_blocks(index(t), path, 8)
    out = im.block_topk(t.questions(), im.read_blocks(t.spark, path), 3)
    return out.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


@query(
    "bm25_terms",
    f"WITH {POSTINGS} SELECT term, df, n, round(avgdl, 4) AS avgdl, round({IDF}, 4) AS idf FROM vocabulary, corpus",
)
def bm25_terms(t):
    i = index(t)
    n, avgdl = i.corpus.select("n").scalar(), i.corpus.select("avgdl").scalar()
    return i.terms.select("term", "df", n.alias("n"), F.round(avgdl, 4).alias("avgdl"),
                    F.round(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1), 4).alias("idf"))


@query(
    "bm25_raw_tf",
    f"""WITH toks AS (SELECT doc_id, {tok('text')} AS bag FROM documents),
post AS (SELECT doc_id, len(bag)::DOUBLE AS dl, unnest(bag) AS term FROM toks),
postings AS (SELECT term, doc_id, dl, count(*) AS tf FROM post GROUP BY ALL),
corpus AS (SELECT count(*) AS n, avg(len(bag)) AS avgdl FROM toks),
vocabulary AS (SELECT term, count(*) AS df FROM postings GROUP BY term), {QTERMS},
s AS (SELECT query_id, doc_id, sum({IDF} * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM qterms JOIN vocabulary USING (term) JOIN postings USING (term), corpus GROUP BY query_id, doc_id)
SELECT * FROM (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank
  FROM s) WHERE rank <= 3""",
)
def bm25_raw_tf(t):
    out = ix.bm25_topk(t.questions(), ix.build_index(t.docs(), tf="raw"), 3)
    return out.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


EXPANDED = f"""{POSTINGS}, {QTERMS}, {MIXED},
{scored('qterms', 'base')},
extra AS (SELECT e.query_id, e.term AS expansion FROM expansion e JOIN words w USING (query_id)
          WHERE lower(e.term) <> lower(w.query) AND length(e.term) > 1),
sub AS (SELECT expansion AS query_id, unnest(list_distinct({tok('expansion')})) AS term FROM (SELECT DISTINCT expansion FROM extra)),
{scored('sub', 'side')},
total AS (SELECT query_id, doc_id, sum(score) AS score FROM (
   SELECT query_id, doc_id, score FROM base WHERE rank <= 20 UNION ALL
   SELECT e.query_id, s.doc_id, s.score * 0.3 FROM extra e JOIN side s ON s.query_id = e.expansion WHERE s.rank <= 20)
   GROUP BY query_id, doc_id),
keyword AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM total)"""


def expanded(t: Tables):
    q = t.questions()
    return ix.bm25_expanded(q, tm.expand_mixed(q, synonyms(t)), index(t), 3)


@query("bm25_expanded", f"WITH {EXPANDED} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM keyword WHERE rank <= 20")
def bm25_expanded(t):
    return expanded(t).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


@query(
    "bm25_multiterm",
    f"""WITH {POSTINGS}, {MIXED},
bag AS (SELECT query_id, unnest(list_distinct({tok('term')})) AS term FROM expansion),
weighted AS (SELECT query_id, term, count(*) AS w FROM bag GROUP BY ALL),
{scored('weighted', 'm', 'w')} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM m WHERE rank <= 3""",
)
def bm25_multiterm(t):
    out = ix.bm25_multiterm(tm.expand_mixed(t.questions(), synonyms(t)), index(t), 3)
    return out.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


def slots(table: str, id: str, dim: int) -> str:
    return f"""{table}_n AS (SELECT {id}, (('0x' || substr(md5(t), 1, 8))::UBIGINT % {dim})::BIGINT AS slot, count(*) AS n
  FROM (SELECT {id}, unnest({tok('text')}) AS t FROM {table}) GROUP BY ALL),
{table}_slots AS (SELECT {id}, slot, n / sqrt(sum(n * n) OVER (PARTITION BY {id})) AS value FROM {table}_n)"""


@query("hash_embed", f"WITH {slots('documents', 'doc_id', 256)} SELECT doc_id, slot, round(value, 6) AS value FROM documents_slots")
def hash_embed(t):
    dense = ix.hash_embed(t.docs()).select("doc_id", F.posexplode("embedding").alias("slot", "value")).filter("value <> 0")
    return dense.select("doc_id", F.col("slot").cast("long"), F.round("value", 6).alias("value"))


@query("hash_slots", f"WITH {slots('documents', 'doc_id', 256)} SELECT doc_id, slot, round(value, 6) AS value FROM documents_slots")
def hash_slots(t):
    return ix.hash_slots(t.docs()).select("doc_id", "slot", F.round("value", 6).alias("value"))


CENTROIDS = """parts AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY label, i),
centroids AS (SELECT label AS query_id, list(m ORDER BY i) AS q FROM parts GROUP BY label)"""


@query(
    "vector_topk",
    f"""WITH {CENTROIDS}, s AS (
  SELECT query_id::BIGINT AS query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, centroids)
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
)
def vector_topk(t):
    e = t("embeddings")
    means = (
        e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
        .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("s"))
        .select(F.col("label").cast("long").alias("query_id"), F.col("s.m").alias("embedding"))
    )
    out = ix.vector_topk(means, e.select("vec_id", "embedding"), 10)
    return out.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


PROBES = """q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS score FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"""


def vector_index(t: Tables, lists: int):
    path = f"{stored_root(t.spark)}/vectors-{uuid.uuid4().hex}"
    vx.write_vector_index(t("embeddings"), path, lists=lists)
    return vx.read_vector_index(t.spark, path)


def vector_queries(t: Tables):
    return t("embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query("vector_all_probes", f"WITH {PROBES} SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 10")
def vector_all_probes(t):
    """The stored index with every list probed: exact."""
    out = vx.approximate_topk(vector_queries(t), vector_index(t, 16), 10, probes=16, block=32)
    return out.select("query_id", "vec_id", "score", F.col("rank").cast("long"))


@query("vector_recall", f"WITH {PROBES} SELECT count(*) AS wanted, count(DISTINCT query_id) AS queries, true AS reached FROM r WHERE rank <= 10")
def vector_recall(t):
    """Recall of the ten nearest with the chosen number of probes, against the exact search; at least 0.9 is asked for."""
    own = stored(ix.vector_topk(vector_queries(t), t("embeddings").select("vec_id", "embedding"), 10), "exact")
    held = vx.recall(vx.approximate_topk(vector_queries(t), vector_index(t, 16), 10), own)
    return held.agg(F.sum("wanted").alias("wanted"), F.count("*").alias("queries"), (F.sum("held") >= 0.9 * F.sum("wanted")).alias("reached"))


VECTOR = f"""{slots('documents', 'doc_id', 256)}, {slots('benchmark', 'item_id', 256)},
dots AS (SELECT item_id AS query_id, doc_id, sum(q.value * d.value) AS score
  FROM benchmark_slots q JOIN documents_slots d USING (slot) GROUP BY ALL),
vec AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM dots)"""


@query(
    "embed_custom",
    "SELECT item_id AS query_id, length(text)::DOUBLE AS a, (length(text) - length(replace(text, 'e', '')))::DOUBLE AS b FROM benchmark",
)
def embed_custom(t):
    """An embedding function of the caller's own in place of the hash vectors."""
    own = lambda text: F.array(F.length(text).cast("double"), (F.length(text) - F.length(F.replace(text, F.lit("e"), F.lit("")))).cast("double"))
    out = ix.embed(t.questions(), own, id="query_id", text="query")
    return out.select("query_id", F.col("embedding")[0].alias("a"), F.col("embedding")[1].alias("b"))


def vector_docs(t: Tables, k: int = 20):
    q = ix.hash_embed(t.questions().withColumnRenamed("query", "text"), id="query_id")
    return ix.vector_topk(q, ix.hash_embed(t.scanned_docs()), k, id="doc_id")


@query(
    "rank_fusion",
    f"""WITH {BM25}, {VECTOR}, lists AS (
  SELECT query_id, doc_id, rank, 3.0 AS w FROM bm25 WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, rank, 1.0 FROM vec WHERE rank <= 20)
SELECT query_id, doc_id, round(sum(w / (60 + rank)), 6) AS score FROM lists GROUP BY query_id, doc_id""",
)
def rank_fusion(t):
    kw = ix.bm25_topk(t.questions(), index(t), 20).select("query_id", "doc_id", "rank", F.lit(3.0).alias("weight"))
    vec = vector_docs(t).select("query_id", "doc_id", "rank", F.lit(1.0).alias("weight"))
    return ix.rank_fusion(kw.unionByName(vec)).withColumn("score", F.round("score", 6))


def hybrid_sql(order: str) -> str:
    return f"""WITH {EXPANDED}, {VECTOR}, fused AS (
  SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS score, max(v) AS in_vector FROM (
    SELECT query_id, doc_id, rank, 1 AS v FROM vec WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, rank, 0 FROM keyword WHERE rank <= 20)
  GROUP BY query_id, doc_id)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order} round(score, 6) DESC, doc_id) AS rank FROM fused)
WHERE rank <= 20"""


@query("hybrid_search", hybrid_sql(""))
def hybrid_search(t):
    return ix.hybrid(vector_docs(t), expanded(t)).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


@query("hybrid_append", hybrid_sql("in_vector DESC,"))
def hybrid_append(t):
    return ix.hybrid(vector_docs(t), expanded(t), fusion="append").select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))
