"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.catalog.base import ANSWERS, SECTIONS, Tables, query
from clausemill.catalog.rerank import candidates
from clausemill.catalog.rules import any_sql
from clausemill.catalog.search import BM25, VECTOR, index, vector_docs
from clausemill.catalog.terms import STOP, STOP_SQL
from clausemill.functions import text as tx
from clausemill.operators import evaluate as ev
from clausemill.operators import index as ix

EXP = f"{BM25}, {VECTOR}, ex AS (SELECT query_id, doc_id FROM vec WHERE rank <= 2), res AS (SELECT * FROM bm25 WHERE rank <= 5)"
HITS = f"{EXP}, hits AS (SELECT DISTINCT e.query_id, CASE WHEN EXISTS (SELECT 1 FROM res r JOIN ex x ON x.query_id = r.query_id AND x.doc_id = r.doc_id WHERE r.query_id = e.query_id AND r.rank <= 3) THEN 1 ELSE 0 END AS hit FROM ex e)"


def hits(t: Tables):
    res = ix.bm25_topk(t.questions(), index(t), 5)
    return ev.recall_at_k(res, vector_docs(t, 2).select("query_id", "doc_id"), 3)


@query("recall_at_k", f"WITH {HITS} SELECT query_id, hit::BIGINT AS hit FROM hits")
def recall_at_k(t):
    return hits(t).withColumn("hit", F.col("hit").cast("long"))


@query(
    "keyword_recall_at_k",
    f"""WITH {BM25}, kw AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z]{{6,}}')) AS keyword FROM benchmark),
f AS (SELECT query_id, keyword, EXISTS (SELECT 1 FROM bm25 b JOIN documents d USING (doc_id) WHERE b.query_id = kw.query_id AND b.rank <= 3 AND contains(lower(d.text), keyword)) AS f FROM kw)
SELECT query_id, max(f::INT)::BIGINT AS hit, round(avg(f::INT), 6) AS share FROM f GROUP BY query_id""",
)
def keyword_recall_at_k(t):
    res = ix.bm25_topk(t.questions(), index(t), 3).join(t.docs(), "doc_id").select("query_id", "rank", "text")
    kw = t.questions().select("query_id", F.explode(F.array_distinct(tx.matches(F.lower("query"), "[a-z]{6,}"))).alias("keyword"))
    return ev.keyword_recall_at_k(res, kw, 3).select("query_id", F.col("hit").cast("long"), F.round("share", 6).alias("share"))


@query(
    "source_recall_at_k",
    f"""WITH {BM25}, x AS (SELECT b.item_id AS query_id, source FROM benchmark b JOIN documents d ON d.doc_id = b.item_id)
SELECT query_id, max((EXISTS (SELECT 1 FROM bm25 r JOIN documents d USING (doc_id) WHERE r.query_id = x.query_id AND r.rank <= 3 AND d.source = x.source))::INT)::BIGINT AS hit FROM x GROUP BY query_id""",
)
def source_recall_at_k(t):
    d = t("documents").select("doc_id", "source")
    res = ix.bm25_topk(t.questions(), index(t), 3).join(d, "doc_id").select("query_id", "rank", "source")
    expected = t.questions().join(d.withColumnRenamed("doc_id", "query_id"), "query_id").select("query_id", "source")
    return ev.source_recall_at_k(res, expected, 3).withColumn("hit", F.col("hit").cast("long"))


@query(
    "recall_breakdown",
    f"""WITH {HITS}, d AS (SELECT hit, CASE WHEN contains(text, ' the ') THEN 'en' ELSE 'other' END AS language, CASE WHEN length(text) > 200 THEN 'long' ELSE 'short' END AS kind FROM hits JOIN benchmark ON item_id = query_id)
SELECT coalesce(language, '*') AS language, coalesce(kind, '*') AS kind, count(*) AS n, round(avg(hit), 6) AS recall FROM d GROUP BY ROLLUP(language, kind)""",
)
def recall_breakdown(t):
    q = t.questions().select("query_id", F.when(F.col("query").contains(" the "), "en").otherwise("other").alias("language"),
                             F.when(F.length("query") > 200, "long").otherwise("short").alias("kind"))
    return ev.recall_breakdown(hits(t).join(q, "query_id"), ["language", "kind"]).withColumn("recall", F.round("recall", 6))


@query(
    "intent_accuracy",
    """WITH r AS (SELECT CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS expected, (CASE WHEN n_chars > 900 AND NOT regexp_matches(text, '[#$%&*]{3}') THEN 'good' ELSE 'bad' END) = (CASE quality WHEN 1 THEN 'good' ELSE 'bad' END) AS ok
  FROM labels JOIN documents USING (doc_id)) SELECT coalesce(expected, '*') AS expected, count(*) AS n, count(*) FILTER (ok) AS correct, round(avg(ok::INT), 6) AS accuracy FROM r GROUP BY ROLLUP(expected)""",
)
def intent_accuracy(t):
    pred = t("documents").select(F.col("doc_id").alias("id"), F.when((F.col("n_chars") > 900) & ~F.col("text").rlike("[#$%&*]{3}"), "good").otherwise("bad").alias("intent"))
    gold = t("labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("expected"))
    return ev.intent_accuracy(pred, gold).withColumn("accuracy", F.round("accuracy", 6))


GOLDEN = """golden AS (SELECT doc_id AS id, source AS regulation, lang AS language, string_split(text, chr(10))[1] AS query, regexp_extract_all(text, '[A-Z][a-z]{3,}') AS sections,
  regexp_extract_all(text, '[a-z]{5,}') AS keywords, CASE WHEN toxic = 1 THEN 'flag' WHEN quality = 1 THEN 'fact' END AS answer_type FROM labels JOIN documents USING (doc_id))"""


def golden(t: Tables):
    return t("labels").join(t("documents"), "doc_id").select(
        F.col("doc_id").alias("id"), F.col("source").alias("regulation"), F.col("lang").alias("language"), F.split("text", "\n")[0].alias("query"),
        tx.matches(F.col("text"), "[A-Z][a-z]{3,}").alias("sections"), tx.matches(F.col("text"), "[a-z]{5,}").alias("keywords"),
        F.when(F.col("toxic") == 1, "flag").when(F.col("quality") == 1, "fact").alias("answer_type"))


@query(
    "golden_summary",
    f"""WITH {GOLDEN}, s AS (SELECT unnest(sections) AS key FROM golden), k AS (SELECT unnest(keywords) AS key FROM golden), ts AS (SELECT key, count(*) AS value FROM s GROUP BY key ORDER BY value DESC, key LIMIT 10),
tk AS (SELECT key, count(*) AS value FROM k GROUP BY key ORDER BY value DESC, key LIMIT 10)
SELECT metric, coalesce(key, '') AS key, round(value, 6)::DOUBLE AS value FROM (SELECT 'total' AS metric, '' AS key, count(*)::DOUBLE AS value FROM golden UNION ALL SELECT 'mean_keywords', '', avg(len(keywords)) FROM golden
UNION ALL SELECT 'regulation', regulation, count(*) FROM golden GROUP BY regulation UNION ALL SELECT 'language', language, count(*) FROM golden GROUP BY language UNION ALL SELECT 'answer_type', answer_type, count(*) FROM golden GROUP BY answer_type
UNION ALL SELECT 'top_sections', key, value FROM ts UNION ALL SELECT 'top_keywords', key, value FROM tk)""",
)
def golden_summary(t):
    return ev.golden_summary(golden(t)).select("metric", F.coalesce("key", F.lit("")).alias("key"), F.round("value", 6).alias("value"))


@query(
    "validate_golden",
    f"""WITH {GOLDEN}, g AS (SELECT * FROM golden UNION ALL SELECT * FROM golden WHERE language = 'de')
SELECT 'duplicate' AS rule, id::VARCHAR AS id FROM g GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'blank_query', id::VARCHAR FROM g WHERE trim(query) = '' UNION ALL SELECT 'language', id::VARCHAR FROM g WHERE language NOT IN ('en', 'fr', 'de')
UNION ALL SELECT 'missing_answer_type', id::VARCHAR FROM g WHERE answer_type IS NULL UNION ALL SELECT 'coverage', r FROM (VALUES ('src1'), ('src77')) v(r) WHERE r NOT IN (SELECT regulation FROM g) UNION ALL SELECT 'minimum', count(*)::VARCHAR FROM g HAVING count(*) < 1000000""",
)
def validate_golden(t):
    g = golden(t)
    return ev.validate_golden(g.unionByName(g.filter("language = 'de'")), ["answer_type"], ["en", "fr", "de"], ["src1", "src77"], 1000000)


WORDS = ["tion", "ment"]


@query(
    "retrieval_scorecard",
    f"""WITH {BM25}, {SECTIONS}, q AS (SELECT item_id AS query_id, CASE WHEN contains(text, ' the ') THEN 'english' ELSE 'other' END AS scenario FROM benchmark),
r AS (SELECT b.query_id, b.score, s.title, s.text, s.page, s.number, s.lang, {any_sql('lower(s.title)', WORDS)} OR {any_sql('s.text', WORDS)} AS related FROM bm25 b JOIN sections s ON s.ordinal = b.doc_id WHERE rank <= 3),
f AS (SELECT query_id, CASE WHEN NOT related THEN 0 WHEN length(text) < 20 THEN 0.5 ELSE 1 END AS grade, NOT related AS u, length(text) > 0 AND length(text) < 20 AS th, least(score / 20 * 30, 30.0) AS quality, least(score * 0.3::DOUBLE, 30.0) AS relevance,
  30 + 30 + 0 + CASE WHEN score >= 20 THEN 20 ELSE 0 END AS use, CASE WHEN length(text) > 100 THEN 30.0 ELSE 0 END AS detail FROM r),
s AS (SELECT scenario, count(DISTINCT q.query_id) AS queries, count(DISTINCT CASE WHEN grade IS NOT NULL THEN q.query_id END) AS answered, count(grade) AS results, coalesce(avg(grade), 0) AS grade, coalesce(avg(quality), 0) AS quality, coalesce(avg(relevance), 0) AS relevance,
  coalesce(avg(use), 0) AS use, coalesce(avg(detail), 0) AS detail, coalesce(bool_or(u), false) AS u, coalesce(bool_or(th), false) AS th FROM q LEFT JOIN f USING (query_id) GROUP BY scenario),
o AS (SELECT scenario, grade * 100 AS accuracy, round(least(answered::DOUBLE / queries * 40 + least(results::DOUBLE / (queries * 3) * 30, 30) + quality, 100) + 1e-9::DOUBLE, 1) AS completeness, CASE WHEN u THEN 0.8::DOUBLE WHEN th THEN 0.3::DOUBLE ELSE 0 END AS hallucination,
  round(least(use, 100) + 1e-9::DOUBLE, 1) AS usability, round(least(answered::DOUBLE / queries * 40 + detail + relevance, 100) + 1e-9::DOUBLE, 1) AS confidence FROM s)
SELECT scenario, round(accuracy, 6)::DOUBLE AS accuracy, completeness, hallucination, usability, confidence, CASE WHEN (accuracy + completeness + (100 - hallucination * 100) + usability) / 4 >= 80 THEN 'excellent' WHEN (accuracy + completeness + (100 - hallucination * 100) + usability) / 4 >= 70 THEN 'good'
  WHEN (accuracy + completeness + (100 - hallucination * 100) + usability) / 4 >= 60 THEN 'fair' ELSE 'poor' END AS overall FROM o""",
)
def retrieval_scorecard(t):
    q = t.questions().select("query_id", F.when(F.col("query").contains(" the "), "english").otherwise("other").alias("scenario"))
    page = t.sections().select(F.col("ordinal").alias("doc_id"), "page")
    r = candidates(t).filter("rank <= 3").join(page, "doc_id").select(
        "query_id", F.col("base").alias("score"), "title", "text", "section", F.col("document").alias("chapter"), "page",
        F.lit("").alias("document_id"), F.lit("").alias("version"))
    return ev.retrieval_scorecard(q, r, WORDS).withColumn("accuracy", F.round("accuracy", 6))


@query(
    "keyword_pass_rate",
    f"""WITH {ANSWERS}, e AS (SELECT answer_id, answer, CASE WHEN length(query) > 150 THEN 'long' ELSE 'short' END AS category, list_distinct(regexp_extract_all(query, '[a-z]{{4,}}')) AS k FROM answers),
o AS (SELECT category, len(k) > 0 AND len(list_filter(k, lambda w: contains(answer, w))) >= len(k) * 0.5 AS ok FROM e) SELECT category, count(*) AS n, count(*) FILTER (ok) AS passed, round(avg(ok::INT), 6) AS rate FROM o GROUP BY category""",
)
def keyword_pass_rate(t):
    a = t.answers()
    e = a.select("answer_id", F.when(F.length("query") > 150, "long").otherwise("short").alias("category"), F.array_distinct(tx.matches(F.col("query"), "[a-z]{4,}")).alias("keywords"))
    return ev.keyword_pass_rate(a, e).withColumn("rate", F.round("rate", 6))


@query(
    "tokenizer_compare",
    rf"""WITH a AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[\s,，。？！]+'), lambda w: length(w) >= 2)) AS a,
  list_distinct(list_filter(regexp_extract_all(lower(text), '\p{{L}}+|\p{{N}}+'), lambda w: length(w) >= 2 AND w NOT IN {STOP_SQL})) AS b FROM documents)
SELECT doc_id, len(a) AS plain, len(b) AS enhanced, round(1 - CASE WHEN len(a) > 0 THEN len(b)::DOUBLE / len(a) ELSE 1 END, 6) AS reduction, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, b))::DOUBLE / len(a) ELSE 0 END, 6) AS kept FROM a""",
)
def tokenizer_compare(t):
    out = ev.tokenizer_compare(t.docs(), STOP)
    return out.withColumns({"reduction": F.round("reduction", 6), "kept": F.round("kept", 6)})


LIMITS = [("latency", "<=", 400.0), ("recall", ">=", 0.7), ("missing", ">=", 1.0), ("short_share", "<=", 0.9)]


@query(
    "gate",
    f"""WITH {HITS}, m AS (SELECT 'recall' AS metric, avg(hit) AS value FROM hits UNION ALL SELECT 'latency', avg(value) FROM events UNION ALL SELECT 'short_share', avg((n_chars < 500)::INT) FROM documents),
l(metric, op, threshold) AS (VALUES {', '.join(str(x) for x in LIMITS)})
SELECT metric, op, round(coalesce(value, -1), 6)::DOUBLE AS value, coalesce(CASE op WHEN '<=' THEN value <= threshold ELSE value >= threshold END, false) AS passed FROM l LEFT JOIN m USING (metric)""",
)
def gate(t):
    m = hits(t).agg(F.avg("hit").alias("value")).select(F.lit("recall").alias("metric"), "value").union(
        t("events").agg(F.avg("value")).select(F.lit("latency"), "avg(value)")).union(
        t("documents").agg(F.avg((F.col("n_chars") < 500).cast("double")).alias("v")).select(F.lit("short_share"), "v"))
    out = ev.gate(m, t.rows("metric string, op string, threshold double", LIMITS))
    return out.select("metric", "op", F.round(F.coalesce("value", F.lit(-1.0)), 6).alias("value"), "passed")


@query(
    "chunk_coverage",
    f"WITH {SECTIONS} SELECT 'doc' AS dimension, doc AS key, count(*) AS chunks FROM sections GROUP BY doc UNION ALL SELECT 'lang', lang, count(*) FROM sections GROUP BY lang UNION ALL SELECT 'number', number, count(*) FROM sections GROUP BY number",
)
def chunk_coverage(t):
    return ev.chunk_coverage(t.sections(), ["doc", "lang", "number"])
