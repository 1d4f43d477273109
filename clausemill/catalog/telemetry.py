"""Corpus-quality and telemetry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.catalog.base import SECTIONS, Tables, query
from clausemill.catalog.mapping import MEMBERS, members
from clausemill.catalog.structure import HEADERS, headers
from clausemill.operators import telemetry as te

COMPLETE = f"{SECTIONS}, co AS (SELECT doc, count(*) AS sections, avg((length(summary) < 60)::INT) AS short_share FROM sections GROUP BY doc)"


@query("completeness", f"WITH {COMPLETE} SELECT doc, sections, round(short_share, 6) AS short_share, short_share > 0.5 AS issue FROM co")
def completeness(t):
    return te.completeness(t.sections(), 60).withColumn("short_share", F.round("short_share", 6))


@query(
    "validate_headers",
    f"""WITH {HEADERS}, m AS (SELECT doc, concat_ws(',', CASE WHEN total_sections IS NULL THEN 'total_sections' END, CASE WHEN layout IS NULL THEN 'layout' END, CASE WHEN agency IS NULL THEN 'agency' END) AS missing FROM headers)
SELECT doc, missing FROM m WHERE missing <> ''""",
)
def validate_headers(t):
    out = te.validate_headers(headers(t), ["total_sections", "layout", "agency"])
    return out.select("doc", F.array_join("missing", ",").alias("missing"))


@query(
    "corpus_score",
    f"""WITH {COMPLETE}, {HEADERS[HEADERS.index('headers AS'):]}, k AS (SELECT (SELECT count(*) FROM co WHERE short_share > 0.5) AS issues, (SELECT count(*) FROM nation WHERE 'src' || n_nationkey NOT IN (SELECT doc FROM sections)) AS gaps, (SELECT count(*) FROM headers WHERE layout IS NULL) AS invalid)
SELECT issues, gaps, invalid, greatest(0, least(100, 100 - 2 * issues - 3 * gaps - 5 * invalid))::DOUBLE AS score FROM k""",
)
def corpus_score(t):
    issues = te.completeness(t.sections(), 60).filter("issue")
    gaps = t("nation").select(F.concat(F.lit("src"), "n_nationkey").alias("doc")).join(t.sections().select("doc").distinct(), "doc", "left_anti")
    return te.corpus_score(issues, gaps, headers(t).filter("layout is null"))


GATES = """dg AS (SELECT source AS doc, CASE WHEN max(n_chars) > 15000 THEN 'excellent' WHEN max(n_chars) > 8000 THEN 'good' ELSE 'partial' END AS parse_quality, count(*) FILTER (n_chars < 60) AS issues,
  count(DISTINCT lang) * 12 AS terms, count(*) AS links, count(*) FILTER (n_chars > 9000) AS low FROM documents GROUP BY source),
gs AS (SELECT doc, CASE parse_quality WHEN 'excellent' THEN 1.0 WHEN 'good' THEN 0.85 ELSE 0.6 END::DOUBLE AS parse, greatest(0, 1 - issues * 0.1::DOUBLE) AS completeness, least(terms / 50.0::DOUBLE, 1) AS terms_gate, least(links / 100.0::DOUBLE, 1) AS links_gate, greatest(0, 1 - low * 0.2::DOUBLE) AS queries FROM dg)"""


@query(
    "document_gates",
    f"""WITH {GATES}, f AS (SELECT *, (parse + 1e-9 < 0.7)::INT + (completeness + 1e-9 < 0.8)::INT + (terms_gate + 1e-9 < 0.5)::INT + (links_gate + 1e-9 < 0.3)::INT + (queries + 1e-9 < 0.6)::INT AS failed FROM gs)
SELECT doc, parse, round(completeness, 6) AS completeness, round(terms_gate, 6) AS terms_gate, round(links_gate, 6) AS links_gate, round(queries, 6) AS queries, failed::BIGINT AS failed, CASE WHEN failed = 0 THEN 'PASSED' WHEN failed <= 2 THEN 'WARNING' ELSE 'BLOCKED' END AS status FROM f""",
)
def document_gates(t):
    n = F.col("n_chars")
    d = t("documents").groupBy(F.col("source").alias("doc")).agg(
        F.when(F.max(n) > 15000, "excellent").when(F.max(n) > 8000, "good").otherwise("partial").alias("parse_quality"), F.count_if(n < 60).alias("issues"),
        (F.countDistinct("lang") * 12).alias("terms"), F.count("*").alias("links"), F.count_if(n > 9000).alias("low_queries"))
    out = te.document_gates(d)
    return out.select("doc", "parse", *[F.round(c, 6).alias(c) for c in ("completeness", "terms_gate", "links_gate", "queries")], F.col("failed").cast("long"), "status")


@query(
    "parse_validation",
    f"""WITH {SECTIONS}, a AS (SELECT doc, count(*) AS sections FROM sections WHERE length(text) > 400 GROUP BY doc), e AS (SELECT 'src' || n_nationkey AS doc, 20 + n_nationkey * 2::BIGINT AS expected FROM nation)
SELECT doc, expected, coalesce(sections, 0) AS sections, coalesce(sections, 0) > 0 AND coalesce(sections, 0) >= expected * 0.8 AS valid FROM e LEFT JOIN a USING (doc)""",
)
def parse_validation(t):
    e = t("nation").select(F.concat(F.lit("src"), "n_nationkey").alias("doc"), (F.col("n_nationkey") * 2 + 20).cast("long").alias("expected"))
    return te.parse_validation(t.sections().filter("length(text) > 400").groupBy("doc").agg(F.count("*").alias("sections")), e)


@query("new_documents", "SELECT doc_id, 'd' || doc_id AS stem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def new_documents(t):
    stem = lambda df: df.select("doc_id", F.concat(F.lit("d"), "doc_id").alias("stem"))
    return te.new_documents(stem(t("documents")), stem(t("labels")).select("stem"))


@query(
    "latency_percentiles",
    """WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, p::BIGINT AS p, value FROM s, (VALUES (50), (95), (99)) v(p) WHERE i = least(floor(n * p / 100), n - 1)""",
)
def latency_percentiles(t):
    out = te.latency_percentiles(t("events"), "event_type", "value", F.floor(F.col("value") / 5))
    return out.withColumn("p", F.col("p").cast("long"))


@query(
    "confidence_shares",
    """WITH e AS (SELECT event_type, value / 100 AS c FROM events) SELECT event_type, count(*) AS n, round(avg(c), 6) AS mean, round(avg((c >= 0.7)::INT), 6) AS high, round(avg((c >= 0.4 AND c < 0.7)::INT), 6) AS medium, round(avg((c < 0.4)::INT), 6) AS low FROM e GROUP BY event_type""",
)
def confidence_shares(t):
    out = te.confidence_shares(t("events").withColumn("c", F.col("value") / 100), "event_type", "c")
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "high", "medium", "low")])


@query(
    "source_counts",
    "SELECT source, count(*) AS n FROM (SELECT unnest(['u' || (user_id % 37), 'k' || regexp_extract(props, '[0-9]+')]) AS source FROM events) GROUP BY source ORDER BY n DESC, source LIMIT 10",
)
def source_counts(t):
    e = t("events").withColumn("sources", F.array(F.concat(F.lit("u"), F.col("user_id") % 37), F.concat(F.lit("k"), F.get_json_object("props", "$.k"))))
    return te.source_counts(e, "sources")


@query("authority_counts", "SELECT CASE WHEN source LIKE '%1%' THEN 'CAAC' WHEN source LIKE '%2' THEN 'FAA' ELSE 'OTHER' END AS authority, count(*) AS chunks FROM documents GROUP BY 1")
def authority_counts(t):
    return te.authority_counts(t("documents"), "source", [("1", "CAAC"), ("2$", "FAA")])


CATALOG = "catalog AS (SELECT s_suppkey AS id, s_name AS title, CASE WHEN s_acctbal > 7000 THEN 'Core' WHEN s_acctbal > 2000 THEN 'Guidance' ELSE 'Other' END AS layer, n_name AS jurisdiction FROM supplier JOIN nation ON n_nationkey = s_nationkey)"


def catalog(t: Tables):
    b = F.col("s_acctbal")
    return t("supplier").join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.when(b > 7000, "Core").when(b > 2000, "Guidance").otherwise("Other").alias("layer"), F.col("n_name").alias("jurisdiction"))


@query("catalog_filter", f"WITH {CATALOG} SELECT id, title FROM catalog WHERE layer = 'Guidance' AND jurisdiction = 'NATION_7'")
def catalog_filter(t):
    return te.catalog_filter(catalog(t), "guidance", "seven", {"seven": "nation_7"}).select("id", "title")


@query("catalog_by_layer", f"WITH {CATALOG} SELECT l AS layer, count(id) AS entries, coalesce(min(title), '') AS first_title FROM (VALUES ('Core'), ('Guidance'), ('Other'), ('Archive')) v(l) LEFT JOIN catalog ON layer = l GROUP BY l")
def catalog_by_layer(t):
    layers = t.rows("layer string", [("Core",), ("Guidance",), ("Other",), ("Archive",)])
    return te.catalog_by_layer(catalog(t), layers).fillna("", ["first_title"])


@query(
    "corpus_totals",
    f"""WITH {MEMBERS}, m AS (SELECT DISTINCT node_id FROM members WHERE "group" <> 'g0'), x AS (SELECT count(DISTINCT doc) AS documents, count(*) AS clauses, count(m.node_id) AS mapped, count(*) FILTER (summary = '') AS issue_count FROM sections LEFT JOIN m USING (node_id))
SELECT *, round(mapped::DOUBLE / clauses, 6) AS share, CASE WHEN issue_count = 0 THEN 'healthy' WHEN issue_count <= 5 THEN 'good' WHEN issue_count <= 15 THEN 'fair' ELSE 'poor' END AS health FROM x""",
)
def corpus_totals(t):
    return te.corpus_totals(t.sections(), members(t).filter(F.col("group") != "g0")).withColumn("share", F.round("share", 6))


@query(
    "domain_coverage",
    """WITH d AS (SELECT CASE WHEN toxic = 1 THEN 'flagged' WHEN quality = 1 THEN lang END AS domain FROM documents LEFT JOIN labels USING (doc_id))
SELECT coalesce(domain, 'unclassified') AS domain, count(*) AS clauses, round(count(*)::DOUBLE / (SELECT count(*) FROM d), 6) AS share FROM d GROUP BY ALL""",
)
def domain_coverage(t):
    d = t("documents").join(t("labels"), "doc_id", "left")
    d = d.select(F.when(F.col("toxic") == 1, "flagged").when(F.col("quality") == 1, F.col("lang")).alias("domain"))
    return te.domain_coverage(d, "domain").withColumn("share", F.round("share", 6))


@query("low_score_queries", "SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY user_id HAVING avg(value) < 45")
def low_score_queries(t):
    return te.low_score_queries(t("events"), "user_id", "value", 45).withColumn("mean", F.round("mean", 6))
