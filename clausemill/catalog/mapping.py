"""Mapping queries: the same number in different sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.catalog.base import SECTIONS, Tables, query
from clausemill.catalog.rules import any_sql
from clausemill.operators import mapping as mp

REQ = ["that", "que", "nicht"]
MEMBERS = f"""{SECTIONS}, groups AS (SELECT DISTINCT doc, 'g' || (regexp_extract(doc, '[0-9]+')::INT % 4) AS "group" FROM sections),
r AS (SELECT "group", s.* FROM sections s JOIN groups USING (doc)), z AS (SELECT "group", number, count(*) AS records, count(DISTINCT doc) AS documents FROM r GROUP BY ALL HAVING count(*) >= 2),
members AS (SELECT r.*, records, documents FROM r JOIN z USING ("group", number))"""


def members(t: Tables):
    s = t.sections()
    groups = s.select("doc", F.concat(F.lit("g"), (F.regexp_extract("doc", "[0-9]+", 0).cast("int") % 4).cast("string")).alias("group")).distinct()
    return mp.map_by_number(s, groups)


@query("map_by_number", f'WITH {MEMBERS} SELECT "group", number, doc, node_id, records, documents FROM members')
def map_by_number(t):
    return members(t).select("group", "number", "doc", "node_id", "records", "documents")


SCORED = f"""wd AS (SELECT "group", number, w, count(*) AS c FROM (SELECT DISTINCT "group", number, node_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM members) GROUP BY ALL),
cw AS (SELECT "group", number, count(*) AS common_words FROM wd JOIN z USING ("group", number) WHERE c = records GROUP BY ALL),
st AS (SELECT "group", number, max(records) AS records, max(documents) AS documents, var_pop(length(text)) AS variance, bool_and({any_sql('text', REQ)}) AS all_required FROM members GROUP BY ALL),
scored AS (SELECT st.*, coalesce(common_words, 0) AS common_words, least(100.0::DOUBLE, 10 + greatest(0, 10 - variance / 100) + coalesce(common_words, 0) * 2 + CASE WHEN all_required THEN 5 ELSE 0 END) AS score
  FROM st LEFT JOIN cw USING ("group", number))"""


def scored(t: Tables):
    return mp.map_scored(members(t), REQ, "[a-z]+")


@query("map_scored", f'WITH {MEMBERS}, {SCORED} SELECT "group", number, records, documents, common_words, all_required, round(score, 6) AS score FROM scored')
def map_scored(t):
    return scored(t).select("group", "number", "records", "documents", "common_words", "all_required", F.round("score", 6).alias("score"))


LEVEL = "CASE WHEN {0} >= 80 THEN 'high' WHEN {0} >= 60 THEN 'medium' WHEN {0} >= 40 THEN 'low' ELSE 'minimal' END"


@query(
    "similarity_to_first",
    f"""WITH {MEMBERS}, w AS (SELECT "group", number, node_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS words FROM members),
f AS (SELECT "group", number, min(node_id) AS first, arg_min(words, node_id) AS fw FROM w GROUP BY ALL),
p AS (SELECT "group", number, first, node_id, len(list_intersect(words, fw)) AS i, len(words) + len(fw) AS u FROM w JOIN f USING ("group", number) WHERE node_id <> first),
s AS (SELECT *, CASE WHEN u - i > 0 THEN i::DOUBLE / (u - i) ELSE 0 END * 100 AS sim FROM p)
SELECT "group", number, first, node_id, round(sim, 6) AS similarity, {LEVEL.format('sim')} AS level FROM s""",
)
def similarity_to_first(t):
    return mp.similarity_to_first(members(t), "[a-z]{3,}").withColumn("similarity", F.round("similarity", 6))


@query(
    "similar_pairs",
    f"""WITH {MEMBERS}, w AS (SELECT "group", number, node_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS words FROM members),
p AS (SELECT a."group", a.number, a.node_id, b.node_id AS other, len(list_intersect(a.words, b.words)) AS i, len(a.words) + len(b.words) AS u FROM w a JOIN w b ON a."group" = b."group" AND a.number = b.number AND a.node_id < b.node_id),
s AS (SELECT *, CASE WHEN u - i > 0 THEN i::DOUBLE / (u - i) ELSE 0 END * 100 AS sim FROM p)
SELECT "group", number, node_id, other, round(sim, 6) AS similarity, {LEVEL.format('sim')} AS level FROM s WHERE sim >= 40""",
)
def similar_pairs(t):
    return mp.similar_pairs(members(t), "[a-z]{3,}").withColumn("similarity", F.round("similarity", 6))


@query(
    "equivalents",
    f"""WITH {MEMBERS}, w AS (SELECT "group", number, min(doc) AS w_doc FROM members GROUP BY "group", number)
SELECT m."group", w_doc, m.number, doc AS other_doc, node_id AS other FROM members m JOIN w ON m."group" = w."group" AND m.number = w.number WHERE doc <> w_doc""",
)
def equivalents(t):
    m = members(t)
    return mp.equivalents(m, m.groupBy("group", "number").agg(F.min("doc").alias("doc")))


@query(
    "mapping_table",
    f"""WITH {MEMBERS}, f AS (SELECT "group", number, doc, min(node_id) AS node_id FROM members GROUP BY ALL)
SELECT "group", number, string_agg(doc || '=' || node_id, ',' ORDER BY doc) AS sections FROM f GROUP BY "group", number""",
)
def mapping_table(t):
    told = F.array_join(F.transform(F.map_entries("sections"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return mp.mapping_table(members(t)).select("group", "number", told.alias("sections"))


EXPECTED = "ex AS (SELECT DISTINCT 'src' || (n_nationkey) AS doc, 'g' || (n_nationkey % 4) AS \"group\" FROM nation)"


def expected(t: Tables):
    n = t("nation")
    return n.select(F.concat(F.lit("src"), "n_nationkey").alias("doc"), F.concat(F.lit("g"), F.col("n_nationkey") % 4).alias("group"))


@query(
    "mapping_coverage",
    f"""WITH {MEMBERS}, {EXPECTED}, a AS (SELECT doc, count(DISTINCT number) AS sections FROM sections GROUP BY doc), b AS (SELECT doc, count(DISTINCT number) AS mapped FROM members GROUP BY doc)
SELECT doc, coalesce(sections, 0) AS sections, coalesce(mapped, 0) AS mapped, coalesce(sections, 0) > 0 AS available, round(coalesce(mapped::DOUBLE / sections, 0), 6) AS coverage FROM ex LEFT JOIN a USING (doc) LEFT JOIN b USING (doc)""",
)
def mapping_coverage(t):
    return mp.mapping_coverage(t.sections(), members(t), expected(t).select("doc")).withColumn("coverage", F.round("coverage", 6))


@query("coverage_gaps", f'WITH {MEMBERS}, {EXPECTED} SELECT "group", doc FROM ex WHERE ("group", doc) NOT IN (SELECT "group", doc FROM members)')
def coverage_gaps(t):
    return mp.coverage_gaps(members(t), expected(t)).select("group", "doc")


@query("high_quality_share", f'WITH {MEMBERS}, {SCORED} SELECT "group", count(*) AS mappings, count(*) FILTER (score > 50) AS high_quality FROM scored GROUP BY "group"')
def high_quality_share(t):
    return mp.high_quality_share(scored(t))


@query(
    "mapping_quality",
    f"""WITH {MEMBERS}, {SCORED}, q AS (SELECT "group", count(*) AS mappings, sum(score * CASE WHEN all_required THEN 1.5::DOUBLE ELSE 1 END) / count(*) AS quality FROM scored GROUP BY "group")
SELECT "group", mappings, round(quality, 6) AS quality, {LEVEL.format('quality')} AS rating FROM q""",
)
def mapping_quality(t):
    return mp.mapping_quality(scored(t)).withColumn("quality", F.round("quality", 6))


@query(
    "requirement_diff",
    rf"""WITH {MEMBERS} SELECT "group", number, doc, node_id, title, length(text) AS length, array_to_string(list_transform(list_filter(list_transform(regexp_split_to_array(text, '[。.]'),
  lambda s: regexp_replace(s, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')), lambda s: {any_sql('s', REQ)})[1:3], lambda s: substr(s, 1, 100)), '|') AS requirements FROM members""",
)
def requirement_diff(t):
    return mp.requirement_diff(members(t), REQ).withColumn("requirements", F.array_join("requirements", "|"))


@query(
    "term_diff",
    """WITH p AS (SELECT lang, term, count(*) AS n FROM (SELECT DISTINCT doc_id, lang, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS term FROM documents) GROUP BY ALL),
a AS (SELECT term, sum(n)::BIGINT AS n, count(*) AS agencies, min(lang) AS lang FROM p GROUP BY term), k AS (SELECT *, CASE WHEN agencies = (SELECT count(DISTINCT lang) FROM documents) THEN 'common' WHEN agencies = 1 THEN 'unique' ELSE 'some' END AS kind FROM a)
SELECT term, n, agencies, kind, CASE WHEN kind = 'unique' THEN lang ELSE '' END AS agency FROM k""",
)
def term_diff(t):
    return mp.term_diff(t("documents"), "lang", "[A-Z][a-z]{3,}")


@query(
    "mapping_report",
    f"""WITH {MEMBERS}, {SCORED} SELECT "group", number, round(score, 6) AS score, rank, list FROM (
  SELECT "group", number, score, 'best' AS list, row_number() OVER (PARTITION BY "group" ORDER BY round(score, 6) DESC, number) AS rank FROM scored WHERE score > 70
  UNION ALL SELECT "group", number, score, 'worst', row_number() OVER (PARTITION BY "group" ORDER BY round(score, 6), number) FROM scored WHERE score < 40) WHERE rank <= 5""",
)
def mapping_report(t):
    return mp.mapping_report(scored(t)).select("group", "number", F.round("score", 6).alias("score"), F.col("rank").cast("long"), "list")


@query(
    "mapping_totals",
    f"""WITH {MEMBERS}, {SCORED} SELECT 'groups' AS metric, '' AS key, count(DISTINCT "group") AS value FROM scored UNION ALL SELECT 'mappings', '', count(*) FROM scored
UNION ALL SELECT 'good', '', count(*) FROM scored WHERE score > 70 UNION ALL SELECT 'weak', '', count(*) FROM scored WHERE score < 40 UNION ALL SELECT 'document', doc, count(*) FROM members GROUP BY doc""",
)
def mapping_totals(t):
    return mp.mapping_totals(scored(t), members(t))


@query(
    "shared_term_links",
    f"""WITH {SECTIONS}, m AS (SELECT DISTINCT doc, node_id, unnest(regexp_extract_all(lower(title), '[a-z]{{5,}}')) AS term FROM sections)
SELECT a.node_id AS src, b.node_id AS dst, count(*) AS shared, min(term) AS first_term, round(count(*) * 0.3::DOUBLE, 6) AS confidence
FROM m a JOIN m b USING (term) WHERE a.doc <> b.doc AND a.node_id < b.node_id GROUP BY a.node_id, b.node_id ORDER BY shared DESC, src, dst LIMIT 50""",
)
def shared_term_links(t):
    return mp.shared_term_links(t.sections(), "[a-z]{5,}").withColumn("confidence", F.round("confidence", 6))


@query(
    "equivalence_lookup",
    """WITH l AS (SELECT l_orderkey AS link, 'p' || l_partkey AS clause FROM lineitem), w AS (SELECT 'p' || p_partkey AS clause FROM part)
SELECT DISTINCT a.clause AS wanted, b.clause AS other FROM l a JOIN l b USING (link) WHERE a.clause <> b.clause AND a.clause IN (SELECT clause FROM w)""",
)
def equivalence_lookup(t):
    links = t("lineitem").select(F.col("l_orderkey").alias("link"), F.concat(F.lit("p"), "l_partkey").alias("clause"))
    return mp.equivalence_lookup(links, t("part").select(F.concat(F.lit("p"), "p_partkey").alias("clause")))


@query(
    "alignment_status",
    f"""WITH {SECTIONS}, a AS (SELECT (s_suppkey % 9 + 1) || '.' || s_suppkey AS number, 'X.' || s_suppkey AS other_number, CASE WHEN s_acctbal > 5000 THEN 'aligned' ELSE 'partial' END AS status FROM supplier)
SELECT doc, s.number, node_id, coalesce(other_number, '') AS other_number, coalesce(status, 'unmapped') AS status FROM sections s LEFT JOIN a USING (number)""",
)
def alignment_status(t):
    k = F.col("s_suppkey")
    a = t("supplier").select(F.concat((k % 9 + 1).cast("string"), F.lit("."), k.cast("string")).alias("number"), F.concat(F.lit("X."), k).alias("other_number"),
                             F.when(F.col("s_acctbal") > 5000, "aligned").otherwise("partial").alias("status"))
    return mp.alignment_status(t.sections(), a).fillna("", ["other_number"])
