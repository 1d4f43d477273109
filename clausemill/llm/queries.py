"""One registered query per operator, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.llm import (
    centroids, chat, decontamination, fingerprints, hard_negatives, near_dups, packing, quality, secrets, tokens, toxicity, urls, warc,
)
from clausemill.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_token_counts(spark, sf_dir):
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op7_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op8_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge_urls(table(spark, sf_dir, "pages"), rules)


SQL["op8_url_filter"] = r"""
WITH rules(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN (
  SELECT q.host, q.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) q JOIN rules r
    ON (q.host = r.host OR ends_with(q.host, '.' || r.host)) AND starts_with(q.path, r.path)
  GROUP BY q.host, q.path) b ON p.host = b.host AND p.path = b.path"""


@query
def op9_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, words=secrets.ranked_words(docs, public_tokenizers.path("word_bpe_49k.json")))


@query
def op5_near_dups(spark, sf_dir):
    return near_dups.near_dup_classes(table(spark, sf_dir, "documents"))


@query
def op10_decontamination(spark, sf_dir):
    return decontamination.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


@query
def op2_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


@query
def op4_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


@query
def op6_chat_format(spark, sf_dir):
    raw = chat.as_transcript(table(spark, sf_dir, "conversations"))
    return chat.recover(raw, chat.learn(raw.withColumnRenamed("part", "turn")))


@query
def op11_warc(spark, sf_dir):
    return warc.archive(table(spark, sf_dir, "pages"))


SQL["op11_warc"] = r"""
WITH body AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
hashed AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex FROM body),
coded AS (
  SELECT page_id, payload_bytes, list_aggregate(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::BIGINT >> (5 * (3 - i % 4))) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest FROM hashed),
kept AS (SELECT payload_digest, max(page_id) AS last FROM coded GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM coded JOIN kept USING (payload_digest)"""


@query
def op12_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved))


SQL["op12_hard_negatives"] = r"""
WITH rows AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.id AS anchor_id, b.id, b.label = a.label AS same, CAST(list_dot_product(a.x::DOUBLE[], b.x::DOUBLE[]) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.id % 100 = 0 AND a.id <> b.id),
positive AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS n FROM scored WHERE same) WHERE n <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score
FROM (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM positive p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
WHERE rank <= 5"""


@query
def op13_centroids(spark, sf_dir):
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def lloyd_sql(rounds: int = 5, count: int = 40) -> str:
    """The rounds written out, components as rows."""
    parts = ["""kept AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""", """part AS (
  SELECT vec_id, d, CAST(floor(256 * CAST(embedding[d] AS DOUBLE)) AS BIGINT) AS x FROM kept, generate_series(1, 64) AS g(d))""", f"""start AS (
  SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM kept QUALIFY c < {count})""",
             "c0 AS (SELECT c, d, x FROM start JOIN part USING (vec_id))"]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT vec_id, min(distance * {count} + c) % {count} AS c, min(distance * {count} + c) // {count} AS distance FROM (
    SELECT p.vec_id, m.c, CAST(sum((p.x - m.x) * (p.x - m.x)) AS BIGINT) AS distance FROM part p JOIN c{i} m USING (d) GROUP BY 1, 2) GROUP BY 1)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT m.c, m.d, coalesce(n.x, m.x) AS x FROM c{i} m LEFT JOIN (
    SELECT c, d, CAST((s - ((s % k) + k) % k) // k AS BIGINT) AS x FROM (
      SELECT a.c, p.d, CAST(sum(p.x) AS BIGINT) AS s, count(*) AS k FROM a{i} a JOIN part p USING (vec_id) GROUP BY 1, 2)) n ON m.c = n.c AND m.d = n.d)""")
    return f"""WITH {", ".join(parts)},
digest AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS h FROM c{rounds} GROUP BY 1)
SELECT vec_id, CAST(c AS INT) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM a{rounds} JOIN digest USING (c)"""


SQL["op13_centroids"] = lloyd_sql()

QUERIES["pipeline"] = corpus_pipeline.run
