"""Rerank and scored-search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.catalog.base import SECTIONS, Tables, query, tok
from clausemill.catalog.rules import INTENT, PATTERNS, SUBS, any_sql, user_turns
from clausemill.catalog.search import BM25, DICT, MIXED, POSTINGS, index, scored, synonyms
from clausemill.functions import text as tx
from clausemill.functions.scale import stored
from clausemill.operators import index as ix
from clausemill.operators import rerank as rr
from clausemill.operators import rules as ru
from clausemill.operators import terms as tm

INTENT_B = INTENT.replace(
    "SELECT conv_id * 100 + turn AS query_id, text AS query, lower(text) AS low FROM conversations WHERE role = 'user'",
    "SELECT item_id AS query_id, text AS query, lower(text) AS low FROM benchmark",
)
BONUS = {"regulatory": (["shall", "tion"], 6.0), "method": (["ing"], 5.0), "comparison": (["and"], 5.0), "definition": (["que"], 4.0), "numerical": (["max", "ment"], 3.0)}
WEIGHTS = {"SRC1": 9.0, "EN": 4.0}
TERM = "[a-z]{5,}"


def candidates(t: Tables):
    meta = t.sections().select(
        F.col("ordinal").alias("doc_id"), "title", F.lit("").alias("chapter"), F.col("number").alias("section"),
        F.col("doc").alias("document"), F.col("lang").alias("document_type"), "text")
    return ix.bm25_topk(t.questions(), index(t), 12).select("query_id", "doc_id", F.col("score").alias("base"), "rank").join(meta, "doc_id")


BONUS_SQL = " + ".join(
    f"CASE WHEN coalesce(im['{i}'], 0) > 0.4 AND {any_sql('lower(text)', w)} THEN {p} ELSE 0 END" for i, (w, p) in BONUS.items()
) + r" + CASE WHEN coalesce(im['numerical'], 0) > 0.4 AND regexp_matches(lower(text), '(?i)\d+[\.\d]*\s*(°C|MPa|kg|rpm|kN|Nm|℃|帕|兆帕)') THEN 5 ELSE 0 END"

RERANK = rf"""{BM25}, {MIXED}, {INTENT_B}, {SECTIONS},
im AS (SELECT query_id, map(list(intent), list(score)) AS im FROM intents GROUP BY query_id),
feat AS (SELECT w.query_id, list_filter({tok('w.query')}, lambda x: length(x) > 1) AS toks,
  (SELECT list(DISTINCT lower(e.term)) FROM expansion e WHERE e.query_id = w.query_id) AS exp,
  list_filter(r, lambda x, i: list_position(r, x) = i)[1:8] AS ph, regexp_extract_all(w.query, '\d+\.\d+') AS cl, im
  FROM words w JOIN im USING (query_id) JOIN (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[a-z][a-z0-9_\-]{{2,}}') AS r FROM benchmark) p USING (query_id)),
cand AS (SELECT b.query_id, b.doc_id, b.rank, b.score AS base, s.doc AS source, s.title, s.number, s.lang, s.text,
  lower(concat_ws(' ', '', s.number, s.doc, s.title, s.text)) AS hay, lower(' ' || s.number) AS sec, lower(s.title) AS head
  FROM bm25 b JOIN sections s ON s.ordinal = b.doc_id WHERE b.rank <= 12),
sc AS (SELECT query_id, doc_id,
  coalesce(list_sum(list_transform(toks, lambda w: CASE WHEN contains(hay, w) THEN CASE WHEN length(w) > 1 THEN 5.0 ELSE 3.0 END ELSE 0 END)), 0)
  + coalesce(list_sum(list_transform(list_filter(exp, lambda w: NOT list_contains(toks, w)), lambda w: CASE WHEN contains(hay, w) THEN 2.0 ELSE 0 END)), 0)
  + coalesce(list_sum(list_transform(ph, lambda p: CASE WHEN contains(sec, p) THEN 15.0 WHEN contains(head, p) THEN 12.0 WHEN contains(hay, p) THEN 6.0 ELSE 0 END)), 0)
  + coalesce(list_sum(list_transform(cl, lambda n: CASE WHEN contains(substr(text, 1, 200), n) THEN 10.0 WHEN contains(hay, n) THEN 5.0 ELSE 0 END)), 0)
  + {BONUS_SQL}
  + CASE WHEN len(list_filter(ph, lambda p: contains(head, p))) > 0 THEN 8 ELSE 0 END
  + CASE WHEN len(list_filter(ph, lambda p: contains(lower(substr(text, 1, 150)), p))) > 0 THEN 4 ELSE 0 END
  + CASE WHEN len(toks) > 0 AND len(list_filter(toks, lambda w: contains(head, w))) >= len(toks) * 0.6 THEN 10 ELSE 0 END
  + greatest(CASE WHEN contains(upper(source), 'SRC1') THEN 9.0 ELSE 0 END, CASE WHEN contains(upper(lang), 'EN') THEN 4.0 ELSE 0 END) AS score
  FROM cand JOIN feat USING (query_id))"""


def features(t: Tables):
    q = t.questions()
    return rr.query_features(q, tm.expand_mixed(q, synonyms(t)), PATTERNS)


@query(
    "rerank_features",
    f"""WITH {RERANK} SELECT query_id, doc_id, round(score, 6)::DOUBLE AS score, rank FROM (
  SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0) WHERE rank <= 4""",
)
def rerank_features(t):
    return rr.rerank(features(t), candidates(t), 4, WEIGHTS, BONUS).withColumn("rank", F.col("rank").cast("long"))


QU = f"""qu AS (SELECT DISTINCT query_id, kind, unit FROM (
  SELECT item_id AS query_id, 'term' AS kind, unnest(regexp_extract_all(lower(text), '{TERM}')) AS unit FROM benchmark
  UNION ALL SELECT item_id, 'number', unnest(regexp_extract_all(text, '\\d+(?:\\.\\d+)?')) FROM benchmark))"""


def section_units_sql(name: str, body: str) -> str:
    return f"""{name} AS (SELECT node_id, kind, unit, max(t) = 1 AS in_title FROM (
  SELECT node_id, 'term' AS kind, unnest(regexp_extract_all(lower(title), '{TERM}')) AS unit, 1 AS t FROM sections
  UNION ALL SELECT node_id, 'term', unnest(regexp_extract_all(lower({body}), '{TERM}')), 0 FROM sections
  UNION ALL SELECT node_id, 'number', unnest(regexp_extract_all(lower(title), '\\d+(?:\\.\\d+)?')), 1 FROM sections
  UNION ALL SELECT node_id, 'number', unnest(regexp_extract_all(lower({body}), '\\d+(?:\\.\\d+)?')), 0 FROM sections) GROUP BY ALL)"""


@query(
    "tree_search",
    f"""WITH {SECTIONS}, {QU}, {section_units_sql('su', "concat_ws(' ', summary, text)")},
s AS (SELECT query_id, node_id, sum(CASE WHEN kind = 'number' THEN 30.0 WHEN in_title THEN 10.0 ELSE 5.0 END) AS score FROM su JOIN qu USING (kind, unit) GROUP BY ALL
  UNION ALL SELECT item_id, node_id, 15 FROM benchmark b, sections c WHERE contains(lower(concat_ws(' ', c.title, c.summary, c.text)), lower(b.text))),
w AS (SELECT query_id, node_id, sum(score) AS score FROM s GROUP BY ALL)
SELECT query_id, node_id, score::DOUBLE AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM w) WHERE rank <= 5""",
)
def tree_search(t):
    return rr.tree_search(t.questions(), t.sections(), 5, TERM).withColumn("rank", F.col("rank").cast("long"))


@query(
    "context_search",
    f"""WITH {SECTIONS}, {DICT}, qt AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN text ELSE text || ' CS-src' || (item_id % 20) || ' ' || item_id END AS query, regexp_replace(lower(substr(text, 5, 40)), '^\\S+\\s+', '') AS normalised FROM benchmark),
qb AS (SELECT DISTINCT query_id, kind, unit FROM (SELECT query_id, 'term' AS kind, unnest(regexp_extract_all(lower(query), '{TERM}')) AS unit FROM qt
  UNION ALL SELECT query_id, 'number', unnest(regexp_extract_all(query, '\\d+(?:\\.\\d+)?')) FROM qt)),
ex AS (SELECT query_id, synonym AS unit, min(ordinal) AS o FROM qb JOIN dict ON term = unit AND kind = 'term' GROUP BY ALL),
ex3 AS (SELECT query_id, unit, row_number() OVER (PARTITION BY query_id ORDER BY o, unit) AS rn FROM ex WHERE (query_id, unit) NOT IN (SELECT query_id, unit FROM qb WHERE kind = 'term')),
u AS (SELECT * FROM qb UNION ALL SELECT query_id, 'expansion', unit FROM ex3 WHERE rn <= 3),
rf AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(query, '(?i)CCAR[-\\s]*(\\d+)', 1) || regexp_extract_all(query, '(?i)FAR[-\\s]*(\\d+)', 1) || regexp_extract_all(query, '(?i)CS[-\\s]*(\\w+)', 1) || regexp_extract_all(query, '(?i)EASA[-\\s]*(\\w+)', 1)) AS ref FROM qt),
{section_units_sql('su', 'summary')},
ev AS (SELECT * FROM su WHERE kind = 'term' OR in_title UNION ALL SELECT node_id, 'expansion', unit, in_title FROM su WHERE kind = 'term' AND in_title),
p AS (SELECT query_id, node_id, max(CASE WHEN kind = 'number' THEN 60.0 ELSE 0 END)
  + sum(CASE WHEN kind = 'term' THEN CASE WHEN in_title THEN 15.0 ELSE 8.0 END WHEN kind = 'expansion' THEN 5.0 ELSE 0 END) AS score FROM ev JOIN u USING (kind, unit) GROUP BY ALL),
w AS (SELECT query_id, node_id, 20.0 AS score FROM qt, sections c WHERE contains(lower(c.title), lower(query)) OR contains(lower(concat_ws(' ', c.summary, c.text)), lower(query))
  UNION ALL SELECT DISTINCT query_id, node_id, 50.0 FROM rf JOIN sections ON length(ref) > 0 AND contains(doc, ref)
  UNION ALL SELECT query_id, node_id, CASE WHEN contains(lower(title), normalised) THEN 10.0 ELSE 5.0 END FROM qt, sections WHERE length(normalised) > 0 AND (contains(lower(title), normalised) OR contains(lower(summary), normalised))),
a AS (SELECT query_id, node_id, sum(score) AS score FROM (SELECT * FROM p UNION ALL SELECT * FROM w) GROUP BY ALL),
z AS (SELECT query_id, node_id, score::DOUBLE * CASE WHEN contains(doc, 'src1') THEN 1.2::DOUBLE ELSE 1 END * CASE WHEN regexp_matches(lower(title), 'tion') THEN 1.1::DOUBLE ELSE 1 END AS score FROM a JOIN sections USING (node_id))
SELECT query_id, node_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, node_id) AS rank FROM z WHERE score > 0) WHERE rank <= 5""",
)
def context_search(t):
    named = F.concat("text", F.lit(" CS-src"), (F.col("item_id") % 20).cast("string"), F.lit(" "), F.col("item_id").cast("string"))
    q = t("benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise(named).alias("query"),
                              F.regexp_replace(F.lower(F.substring("text", 5, 40)), r"^\S+\s+", "").alias("normalised"))
    out = rr.context_search(q, t.sections(), synonyms(t), 5, TERM, ["src1"], "tion")
    return out.select("query_id", "node_id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


@query(
    "cross_references",
    f"""WITH {BM25}, {SECTIONS}, res AS (SELECT b.query_id, s.node_id, s.doc FROM bm25 b JOIN sections s ON s.ordinal = b.doc_id WHERE b.rank <= 3),
qt AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '{TERM}')[1:2])) AS term FROM benchmark),
po AS (SELECT DISTINCT doc AS ref_doc, node_id AS ref, ordinal, unnest(regexp_extract_all(lower(title || ' ' || summary), '{TERM}')) AS term FROM sections),
p AS (SELECT query_id, node_id, ref, min(ordinal) AS ordinal, min(term) AS term FROM res JOIN qt USING (query_id) JOIN po USING (term) WHERE ref_doc <> doc GROUP BY ALL)
SELECT query_id, node_id, ref, term, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, node_id ORDER BY ordinal) AS rank FROM p) WHERE rank <= 3""",
)
def cross_references(t):
    res = ix.bm25_topk(t.questions(), index(t), 3).join(t.sections().select(F.col("ordinal").alias("doc_id"), "node_id", "doc"), "doc_id")
    terms = t.questions().select("query_id", F.explode(F.array_distinct(F.slice(tx.matches(F.lower("query"), TERM), 1, 2))).alias("term"))
    out = rr.cross_references(res.select("query_id", "node_id", "doc"), terms, t.sections(), TERM)
    return out.withColumn("rank", F.col("rank").cast("long"))


@query(
    "related_sections",
    f"""WITH {POSTINGS}, pr AS (SELECT arg_min(doc_id, doc_id) AS query_id, arg_min(text, doc_id) AS query FROM documents GROUP BY source),
pt AS (SELECT query_id, unnest(list_distinct({tok('query')})) AS term FROM pr),
s AS (SELECT query_id, doc_id, sum({"ln((n - df + 0.5) / (df + 0.5) + 1) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / avgdl))"}) AS score
  FROM pt JOIN vocabulary USING (term) JOIN postings USING (term), corpus WHERE query_id <> doc_id GROUP BY ALL)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s) WHERE rank <= 5""",
)
def related_sections(t):
    probes = t("documents").groupBy("source").agg(F.min_by(F.struct("doc_id", "text"), "doc_id").alias("p")).select(
        F.col("p.doc_id").alias("query_id"), F.col("p.text").alias("query"))
    out = rr.related_sections(ix.bm25_scores(ix.query_terms(probes), index(t)), 5)
    return out.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


REQ = ["that", "que", "nicht"]
ENH = f"""e AS (SELECT r.*, list_concat(regexp_extract_all(b.text, '[a-zA-Z]{{2,}}'), []) AS terms, b.text AS query,
  count(*) OVER (PARTITION BY query_id, source) AS same, count(*) OVER (PARTITION BY query_id) AS n FROM r JOIN benchmark b ON b.item_id = r.query_id),
m AS (SELECT *, CASE WHEN len(terms) > 0 THEN len(list_distinct(list_filter(terms, lambda w: contains(lower(text), lower(w)))))::DOUBLE / len(terms) ELSE 0 END AS share,
  CASE WHEN len(list_filter(terms, lambda w: contains(title, w))) > 0 THEN 15.0 ELSE 0 END AS tp, CASE WHEN length(text) > 200 THEN 20.0 WHEN length(text) > 100 THEN 10.0 ELSE 0 END AS lp,
  CASE WHEN same > 1 THEN (same - 1) * 15.0::DOUBLE / n ELSE 0 END AS rp, CASE WHEN contains(query, 'the') AND {any_sql('text', REQ)} THEN 15.0 ELSE 0 END AS qp FROM e),
x AS (SELECT *, least(base * 0.5::DOUBLE + (share * 30 + tp + lp - rp + qp) * 0.5::DOUBLE, 100) AS enhanced FROM m)"""


def result_rows(t: Tables, k: int = 12):
    return candidates(t).filter(F.col("rank") <= k).select("query_id", "doc_id", "title", "text", F.col("document").alias("source"), "base")


@query(
    "enhance_scores",
    f"""WITH {BM25}, {SECTIONS}, r AS (SELECT b.query_id, b.doc_id, s.title, s.text, s.doc AS source, b.score AS base FROM bm25 b JOIN sections s ON s.ordinal = b.doc_id WHERE b.rank <= 12),
{ENH} SELECT query_id, doc_id, round(enhanced, 6) AS enhanced, round(share, 6) AS keyword_match, tp::DOUBLE AS title_points, round(rp, 6) AS repeat_points FROM x""",
)
def enhance_scores(t):
    out = rr.enhance_scores(t.questions(), result_rows(t), "the", REQ)
    return out.select("query_id", "doc_id", F.round("enhanced", 6).alias("enhanced"), F.round("keyword_match", 6).alias("keyword_match"), "title_points",
                      F.round("repeat_points", 6).alias("repeat_points"))


@query(
    "merge_rerank",
    f"""WITH {BM25}, {SECTIONS}, al AS (SELECT b.query_id, b.doc_id, s.title, s.text, s.doc AS source, b.score AS base, b.rank FROM bm25 b JOIN sections s ON s.ordinal = b.doc_id WHERE b.rank <= 12),
both_sets AS (SELECT *, 0 AS st FROM al WHERE rank <= 3 UNION ALL SELECT *, 1 FROM al),
r AS (SELECT query_id, doc_id, title, text, source, base FROM (SELECT *, row_number() OVER (PARTITION BY query_id, title ORDER BY st, doc_id) AS rn FROM both_sets) WHERE rn = 1),
{ENH} SELECT query_id, doc_id, round(enhanced, 6) AS enhanced, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(enhanced, 6) DESC, doc_id) AS rank FROM x) WHERE rank <= 5""",
)
def merge_rerank(t):
    out = rr.merge_rerank(t.questions(), [result_rows(t, 3), result_rows(t)], 5, requirement_word="the", requirement=REQ)
    return out.select("query_id", "doc_id", F.round("enhanced", 6).alias("enhanced"), F.col("rank").cast("long"))


@query(
    "multi_query_search",
    f"""WITH {POSTINGS}, {SUBS}, st AS (SELECT query_id || '/' || sub AS query_id, unnest(list_distinct({tok('text')})) AS term FROM subs), {scored('st', 'sb')},
f AS (SELECT string_split(query_id, '/')[1]::BIGINT AS query_id, string_split(query_id, '/')[2]::BIGINT AS sub, doc_id, rank FROM sb WHERE rank <= 3),
b AS (SELECT query_id, doc_id, min((rank, sub)) AS m FROM f GROUP BY ALL)
SELECT query_id, doc_id, position FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY m, doc_id) AS position FROM b) WHERE position <= 6""",
)
def multi_query_search(t):
    subs = ru.subqueries(user_turns(t), [" and ", " und "])
    units = subs.select(F.concat_ws("/", "query_id", "sub").alias("query_id"), F.col("text").alias("query"))
    parts = F.split("query_id", "/")
    found = ix.bm25_topk(units, index(t), 3).select(
        parts[0].cast("long").alias("query_id"), parts[1].cast("long").alias("sub"), "doc_id", "rank")
    return rr.merge_subqueries(found, 3).select("query_id", "doc_id", F.col("position").cast("long"))


@query(
    "graph_first_search",
    f"""WITH {BM25}, own AS (SELECT query_id, doc_id, rank FROM bm25 WHERE rank <= 6 AND score >= 40), ok AS (SELECT query_id FROM own GROUP BY query_id HAVING count(*) >= 3),
r AS (SELECT query_id, doc_id, rank, 'graph_first' AS strategy FROM own WHERE query_id IN (SELECT query_id FROM ok)
  UNION ALL SELECT query_id, doc_id, rank, 'expanded' FROM bm25 WHERE rank <= 20 AND query_id NOT IN (SELECT query_id FROM ok))
SELECT query_id, doc_id, strategy, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id) AS position FROM r) WHERE position <= 6""",
)
def graph_first_search(t):
    """Passages with three strong results keep them, the others take the wider search."""
    every = stored(ix.bm25_topk(t.questions(), index(t), 20).select("query_id", "doc_id", "rank", "score"), "ranked")
    return rr.graph_first(every.filter("score >= 40"), every, 3).withColumn("position", F.col("position").cast("long"))


@query(
    "multi_source_search",
    f"""WITH {POSTINGS}, q AS (SELECT conv_id * 100 + turn AS query_id, text AS query FROM conversations WHERE role = 'user'),
u AS (SELECT query_id, query, list_prepend(query, CASE WHEN contains(query, ' and ') THEN list_filter(list_transform(string_split(query, ' and '), lambda p: trim(p)), lambda p: length(p) > 2)
  ELSE regexp_extract_all(query, '[a-zA-Z]{{2,}}')[-2:] END) AS r FROM q WHERE trim(query) <> ''),
d AS (SELECT query_id, list_filter(r, lambda x, i: list_position(r, x) = i)[1:4] AS r FROM u),
s AS (SELECT query_id, unnest(range(0, len(r))) AS sub, unnest(r) AS text FROM d),
st AS (SELECT query_id || '/' || sub AS query_id, unnest(list_distinct({tok('text')})) AS term FROM s), {scored('st', 'sb')},
f AS (SELECT string_split(query_id, '/')[1]::BIGINT AS query_id, string_split(query_id, '/')[2]::BIGINT AS sub, doc_id, rank FROM sb WHERE rank <= 3),
b AS (SELECT query_id, doc_id, min((rank, sub)) AS m FROM f GROUP BY ALL)
SELECT query_id, doc_id, position FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY m, doc_id) AS position FROM b) WHERE position <= 9""",
)
def multi_source_search(t):
    asked = t("conversations").filter("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    subs = rr.source_units(asked, [" and "], phrase="[a-zA-Z]{2,}")
    units = subs.select(F.concat_ws("/", "query_id", "sub").alias("query_id"), F.col("text").alias("query"))
    parts = F.split("query_id", "/")
    found = ix.bm25_topk(units, index(t), 3).select(parts[0].cast("long").alias("query_id"), parts[1].cast("long").alias("sub"), "doc_id", "rank")
    return rr.merge_subqueries(found, 3, 3).select("query_id", "doc_id", F.col("position").cast("long"))


@query(
    "relevance_grade",
    f"""WITH {BM25}, g AS (SELECT query_id, count(*) AS n, max(score / 100) AS best, avg(score / 100) AS mean FROM bm25 WHERE rank <= 5 GROUP BY query_id)
SELECT query_id, n, round(greatest(0.3::DOUBLE, least(0.95::DOUBLE, CASE WHEN best >= 0.5 THEN 0.5::DOUBLE + 0.3::DOUBLE * mean + 0.2::DOUBLE * best WHEN best >= 0.3 THEN 0.4::DOUBLE + 0.3::DOUBLE * mean + 0.2::DOUBLE * best ELSE 0.3::DOUBLE + 0.4::DOUBLE * mean END)), 6) AS quality,
  best < 0.15 AND mean < 0.1 AS refine FROM g""",
)
def relevance_grade(t):
    res = ix.bm25_topk(t.questions(), index(t), 5).select("query_id", (F.col("score") / 100).alias("relevance"))
    return rr.relevance_grade(res).select("query_id", "n", F.round("quality", 6).alias("quality"), "refine")


@query(
    "query_clause_map",
    f"""WITH {SECTIONS}, p AS (SELECT DISTINCT unnest(regexp_extract_all(title, '[a-z]{{6,}}')) AS keyword, doc, number FROM sections)
SELECT keyword, doc, number, count(*) OVER (PARTITION BY keyword) AS clauses FROM p""",
)
def query_clause_map(t):
    return rr.query_clause_map(t.sections(), "[a-z]{6,}")


@query(
    "citations",
    rf"""WITH {BM25}, {SECTIONS}, r AS (SELECT b.query_id, b.rank AS num, s.doc AS source, s.number AS section, s.text, substr(s.text, 1, 500) AS cut FROM bm25 b JOIN sections s ON s.ordinal = b.doc_id WHERE b.rank <= 3),
p AS (SELECT *, greatest(500 - strpos(reverse(cut), '.') + 1, 500 - strpos(reverse(cut), chr(10)) + 1) AS pt, greatest(CASE WHEN contains(cut, '.') THEN length(cut) - strpos(reverse(cut), '.') + 1 ELSE 0 END,
  CASE WHEN contains(cut, chr(10)) THEN length(cut) - strpos(reverse(cut), chr(10)) + 1 ELSE 0 END) AS point FROM r)
SELECT query_id, num, source, section, CASE WHEN length(text) <= 600 THEN text ELSE (CASE WHEN point - 1 > 250 THEN substr(cut, 1, point) ELSE cut END) || '...' END AS snippet,
  substr(string_split(text, chr(10))[1], 1, 150) AS highlight FROM p""",
)
def citations(t):
    r = candidates(t).filter(F.col("rank") <= 3).select("query_id", F.col("rank").cast("long"), F.col("document").alias("source"), "section", "text")
    return rr.citations(r, breaks=".")


@query(
    "match_catalog",
    """WITH s AS (SELECT DISTINCT lower(replace(s_name, '#', '_r')) AS source FROM supplier UNION SELECT DISTINCT p_brand || CASE WHEN p_size > 25 THEN '_large' ELSE '' END FROM part
  UNION SELECT DISTINCT o_orderpriority FROM orders UNION SELECT DISTINCT 'x' || p_brand || '_r1' FROM part),
c AS (SELECT DISTINCT p_brand AS id, 'brand ' || p_brand AS title FROM part UNION SELECT DISTINCT o_orderpriority || '-r7', 'priority' FROM orders),
k AS (SELECT source, id, title, CASE WHEN lower(source) = lower(id) THEN 1 WHEN contains(lower(source), lower(id)) THEN 2
  WHEN contains(regexp_replace(regexp_replace(lower(source), '^(doc_|src_)', ''), '[-_]?r[0-9]+$', ''), regexp_replace(lower(id), '[-_]?r[0-9]+$', '')) THEN 3 END AS stage FROM s, c)
SELECT source, stage::BIGINT AS stage, id, title FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY stage, id, title) AS rn FROM k WHERE stage IS NOT NULL) WHERE rn = 1""",
)
def match_catalog(t):
    p = t("part")
    s = t("supplier").select(F.lower(F.replace("s_name", F.lit("#"), F.lit("_r"))).alias("source")).union(
        p.select(F.concat("p_brand", F.when(F.col("p_size") > 25, "_large").otherwise("")))).union(
        t("orders").select("o_orderpriority")).union(p.select(F.concat(F.lit("x"), "p_brand", F.lit("_r1"))))
    c = p.select(F.col("p_brand").alias("id"), F.concat(F.lit("brand "), "p_brand").alias("title")).union(
        t("orders").select(F.concat("o_orderpriority", F.lit("-r7")), F.lit("priority"))).distinct()
    return rr.match_catalog(s, c).withColumn("stage", F.col("stage").cast("long"))
