"""The end-to-end jobs over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.catalog.base import SECTIONS, SQL, Tables, query
from clausemill.catalog.graph import EDGE_TYPES, ENT, HEADER, PATTERNS, TOPIC_CASE, TOPICS
from clausemill.catalog.rerank import BONUS, WEIGHTS
from clausemill.catalog.rules import PATTERNS as INTENTS
from clausemill.catalog.search import index, synonyms
from clausemill.catalog.structure import CHUNKS, markdown
from clausemill.plans import jobs


@query(
    "corpus_chunks",
    f"""WITH {CHUNKS}, c AS (SELECT doc_id, source || ':' || substr(sha1(source || '|' || h2 || '|' || h3 || '|' || substr(original_text, 1, 256) || '|' || seq), 1, 16) AS chunk_id, text FROM chunks)
SELECT chunk_id, min(doc_id) AS doc_id, md5(arg_min(text, doc_id)) AS digest FROM c GROUP BY chunk_id""",
)
def corpus_chunks(t):
    return jobs.corpus_chunks(markdown(t)).select("chunk_id", "doc_id", F.md5("text").alias("digest"))


@query("answer_queries")
def answer_queries(t: Tables):
    docs = t.sections().select(
        F.col("ordinal").alias("doc_id"), "title", F.lit("").alias("chapter"), F.col("number").alias("section"),
        F.col("doc").alias("document"), F.col("lang").alias("document_type"), "text")
    a = jobs.answer_queries(t.questions(), docs, index(t), synonyms(t), patterns=INTENTS, weights=WEIGHTS, bonus=BONUS, end=".")
    first = a.ranking.filter("rank = 1").select("query_id", "doc_id", "score")
    conf = a.confidence.select(F.col("answer_id").alias("query_id"), "summary", "level")
    plan = a.plan.select("query_id", "intent", "strategy", "top_k")
    direct = a.direct.select(F.col("answer_id").alias("query_id"), "direct")
    return plan.join(first, "query_id", "left").join(conf, "query_id", "left").join(direct, "query_id", "left")


@query("build_graph_nodes", f"WITH {SECTIONS}, {ENT} SELECT id, type, label FROM ents UNION ALL SELECT node_id, 'section', title FROM sections")
def build_graph_nodes(t):
    return jobs.build_graph(t.sections(), PATTERNS, EDGE_TYPES, HEADER, TOPICS)[0]


_EQUAL = f"SELECT src, dst, type FROM ({SQL['equivalent_across_documents']})"


@query(
    "build_graph_edges",
    f"""WITH {SECTIONS}, eq AS ({_EQUAL}), k AS (SELECT node_id, topic, row_number() OVER (PARTITION BY topic ORDER BY ordinal) AS rn FROM (SELECT node_id, ordinal, {TOPIC_CASE} AS topic FROM sections) WHERE topic IS NOT NULL),
near AS (SELECT a.node_id AS src, b.node_id AS dst, 'same_topic' AS type FROM k a JOIN k b ON a.topic = b.topic AND b.rn BETWEEN a.rn + 1 AND a.rn + 7
  WHERE NOT EXISTS (SELECT 1 FROM eq WHERE (eq.src = a.node_id AND eq.dst = b.node_id) OR (eq.src = b.node_id AND eq.dst = a.node_id)))
SELECT DISTINCT src, dst, type FROM (SELECT src, dst, type FROM ({SQL['extract_relations']}) UNION ALL SELECT * FROM eq UNION ALL SELECT * FROM near)""",
)
def build_graph_edges(t):
    return jobs.build_graph(t.sections(), PATTERNS, EDGE_TYPES, HEADER, TOPICS)[1].select("src", "dst", "type")
