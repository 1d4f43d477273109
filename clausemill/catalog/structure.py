"""Document structuring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.catalog.base import SECTIONS, Tables, query
from clausemill.functions import text as tx
from clausemill.operators import structure as st

# The given texts have no headings: first line -> #, lines up to 25 characters -> ##, up to 45 -> ###.
MARKDOWN = r"""markdown AS (
  SELECT doc_id, source, array_to_string(list_transform(lines, lambda l, i: CASE WHEN length(trim(l)) = 0 THEN l WHEN i = 1 THEN '# ' || l
    WHEN length(l) <= 25 THEN '## ' || l WHEN length(l) <= 45 THEN '### ' || l ELSE l END), chr(10)) AS text
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents))"""

STRIP = r"regexp_replace({0}, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')"


def markdown(t: Tables):
    line = lambda l, i: (
        F.when(F.length(F.trim(l)) == 0, l).when(i == 0, F.concat(F.lit("# "), l))
        .when(F.length(l) <= 25, F.concat(F.lit("## "), l)).when(F.length(l) <= 45, F.concat(F.lit("### "), l)).otherwise(l)
    )
    return t("documents").select("doc_id", "source", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


CHUNKS = (
    MARKDOWN
    + rf""",
lines AS (SELECT doc_id, source, unnest(l) AS raw, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM markdown)),
heads AS (SELECT *, {STRIP.format('raw')} AS line, CASE WHEN regexp_matches({STRIP.format('raw')}, '^#{{1,3}}[ \t]+\S')
    THEN length(regexp_extract({STRIP.format('raw')}, '^#+')) ELSE 0 END AS level FROM lines),
blocks AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS b,
    CASE WHEN level > 0 THEN {STRIP.format("regexp_replace(line, '^#{1,3}', '')")} END AS title FROM heads),
grouped AS (SELECT doc_id, any_value(source) AS source, b, max(level) AS level, max(title) AS title,
    coalesce(string_agg(CASE WHEN level = 0 AND line <> '' THEN line END, chr(10) ORDER BY pos), '') AS body FROM blocks GROUP BY doc_id, b),
state AS (SELECT *, max(CASE WHEN level = 1 THEN b END) OVER w AS b1, max(CASE WHEN level = 2 THEN b END) OVER w AS b2,
    max(CASE WHEN level = 3 THEN b END) OVER w AS b3 FROM grouped WINDOW w AS (PARTITION BY doc_id ORDER BY b)),
named AS (SELECT s.doc_id, s.source, s.b, s.level, s.body,
    coalesce(h1.title, 'Unknown Document') AS h1,
    CASE WHEN s.b2 IS NOT NULL AND s.b2 > coalesce(s.b1, -1) THEN h2.title ELSE 'General Chapter' END AS h2,
    CASE WHEN s.b3 IS NOT NULL AND s.b3 > greatest(coalesce(s.b1, -1), coalesce(s.b2, -1)) THEN h3.title
         WHEN s.b2 IS NOT NULL AND s.b2 > coalesce(s.b1, -1) THEN 'General Section' ELSE 'General Clause' END AS h3
  FROM state s LEFT JOIN grouped h1 ON h1.doc_id = s.doc_id AND h1.b = s.b1 LEFT JOIN grouped h2 ON h2.doc_id = s.doc_id AND h2.b = s.b2
  LEFT JOIN grouped h3 ON h3.doc_id = s.doc_id AND h3.b = s.b3),
chunks AS (SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1 AS seq, h1, h2, h3, body AS original_text,
    '[' || h1 || ' > ' || h2 || ' > ' || h3 || ']' || chr(10) || body AS text FROM named WHERE body <> '')"""
)


@query("chunk_by_headings", f"WITH {CHUNKS} SELECT doc_id, seq, h1, h2, h3, text FROM chunks")
def chunk_by_headings(t):
    out = st.chunk_by_headings(markdown(t))
    return out.select("doc_id", F.col("seq").cast("long").alias("seq"), "h1", "h2", "h3", "text")


def chunks(t: Tables):
    c = st.chunk_by_headings(markdown(t))
    src = t("documents").select("doc_id", F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit(".md")).alias("source"))
    return c.join(src, "doc_id").select("doc_id", "source", F.col("h2").alias("chapter"), F.col("h3").alias("section"), "text", "original_text", "seq")


IDS = f"""{CHUNKS}, ided AS (SELECT c.doc_id, c.seq, c.h2, c.original_text, d.lang || ':' || substr(sha1(c.source || '/' || d.lang || '.md|' || c.h2 || '|' || c.h3 || '|' ||
   substr(c.original_text, 1, 256) || '|' || c.seq), 1, 16) AS chunk_id FROM chunks c JOIN documents d USING (doc_id))"""


@query("chunk_ids", f"WITH {IDS} SELECT doc_id, seq, chunk_id FROM ided")
def chunk_ids(t):
    return st.chunk_ids(chunks(t)).select("doc_id", F.col("seq").cast("long").alias("seq"), "chunk_id")


@query(
    "dedupe_chunks",
    """WITH d AS (SELECT lang || ':' || substr(sha1(text), 1, 16) AS chunk_id, doc_id, source, row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) AS rn FROM documents)
SELECT chunk_id, doc_id, source FROM d WHERE rn = 1""",
)
def dedupe_chunks(t):
    d = t("documents").select(F.concat(F.col("lang"), F.lit(":"), F.substring(F.sha1("text"), 1, 16)).alias("chunk_id"), "doc_id", "source")
    return st.dedupe_chunks(d, order="doc_id")


@query(
    "authority_of",
    """SELECT s_suppkey, CASE WHEN upper(s_name) LIKE '%7%' THEN 'CAAC' WHEN upper(s_name) LIKE '%5%' THEN 'FAA' WHEN upper(s_name) LIKE '%SUPPLIER#0000000_3%' THEN 'EASA'
ELSE 'OTHER' END AS authority FROM supplier""",
)
def authority_of(t):
    rules = [("7", "CAAC"), ("5", "FAA"), ("SUPPLIER#0000000.3", "EASA")]
    return t("supplier").select("s_suppkey", st.authority_of(F.col("s_name"), rules).alias("authority"))


@query(
    "split_sections_at_h2",
    rf"""WITH {MARKDOWN}, l AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM markdown)),
g AS (SELECT doc_id, line, pos, sum(CASE WHEN line LIKE '## %' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS s FROM l),
p AS (SELECT doc_id, s, string_agg(line, chr(10) ORDER BY pos) AS section FROM g GROUP BY doc_id, s)
SELECT doc_id, length({STRIP.format('section')})::BIGINT AS size, md5({STRIP.format('section')}) AS digest FROM p WHERE {STRIP.format('section')} <> ''""",
)
def split_sections_at_h2(t):
    body = tx.strip(F.col("section"))
    return st.split_sections_at_h2(markdown(t)).select("doc_id", F.length(body).cast("long").alias("size"), F.md5(body).alias("digest"))


ARTICLES = f"""{CHUNKS}, articles AS (SELECT number, arg_max(body, (length(body), -doc_id)) AS text FROM (
  SELECT doc_id, body, nullif(regexp_extract(title, '^([A-Z][a-z]+)', 1), '') AS number FROM grouped WHERE level IN (2, 3) AND body <> '') WHERE number IS NOT NULL GROUP BY number)"""


@query("article_map", f"WITH {ARTICLES} SELECT number, text FROM articles")
def article_map(t):
    return st.article_map(markdown(t), r"^([A-Z][a-z]+)")


@query(
    "fill_section_text",
    rf"""WITH {SECTIONS}, {ARTICLES}, s AS (SELECT node_id, regexp_extract(title, '^([A-Z][a-z]+)', 1) AS number, title,
  CASE WHEN lang = 'en' THEN summary ELSE '' END AS text, CASE WHEN lang = 'fr' THEN content_parts ELSE [] END AS parts FROM sections)
SELECT node_id, s.number, coalesce(nullif(trim(s.text), ''), nullif(array_to_string(parts, chr(10) || chr(10)), ''), a.text,
  nullif(regexp_extract(title, '^\S+\s+([\s\S]{{11,}})$', 1), '')) AS text FROM s LEFT JOIN articles a USING (number)""",
)
def fill_section_text(t):
    s = t.sections().select(
        "node_id", F.regexp_extract("title", r"^([A-Z][a-z]+)", 1).alias("number"), "title",
        F.when(F.col("lang") == "en", F.col("summary")).otherwise("").alias("text"),
        F.when(F.col("lang") == "fr", F.col("content_parts")).otherwise(F.array().cast("array<string>")).alias("content_parts"),
    )
    return st.fill_section_text(s, st.article_map(markdown(t), r"^([A-Z][a-z]+)")).select("node_id", "number", "text")


@query(
    "sections_from_pages",
    rf"""WITH l AS (SELECT source AS doc, doc_id AS page, list_transform(string_split(text, chr(10)), lambda x: {STRIP.format('x')}) AS l FROM documents),
r AS (SELECT doc, page, unnest(l) AS line, generate_subscripts(l, 1) AS pos, l FROM l),
f AS (SELECT doc, page, pos, CASE WHEN regexp_matches(line, '^([A-Z][a-z]+)\s+(.+)$') THEN regexp_extract(line, '^([A-Z][a-z]+)\s+(.+)$', 1) ELSE regexp_extract(line, '^([A-Z][a-z]+)\.$', 1) END AS number,
  CASE WHEN regexp_matches(line, '^([A-Z][a-z]+)\s+(.+)$') THEN regexp_extract(line, '^([A-Z][a-z]+)\s+(.+)$', 2)
       WHEN regexp_matches(line, '^([A-Z][a-z]+)\.$') AND NOT regexp_matches(coalesce(l[pos + 1], ''), '^\([a-z]\)') THEN coalesce(l[pos + 1], '') END AS t FROM r),
c AS (SELECT doc, page, pos, number, trim(regexp_replace(regexp_replace(regexp_replace(t, '\s*-\s*$', ''), '\.{{3,}}$', ''), '\s+', ' ', 'g')) AS title FROM f),
k AS (SELECT *, CASE WHEN regexp_matches(title, '^\([a-z]\)') OR regexp_matches(title, '^[0-9]+$') OR title IN ('CS-E', 'BOOK', 'AMC', 'Annex') THEN '' ELSE title END AS clean FROM c)
SELECT doc, number, arg_min(clean, (page, pos)) AS title, arg_min(page, (page, pos)) AS page FROM k WHERE length(clean) > 2 GROUP BY doc, number""",
)
def sections_from_pages(t):
    pages = t("documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text")
    return st.sections_from_pages(pages, r"^([A-Z][a-z]+)\s+(.+)$", r"^([A-Z][a-z]+)\.$")


AHEAD = r"""WITH l AS (SELECT source AS doc, doc_id AS page, list_transform(string_split(text, chr(10)), lambda x: STRIPPED) AS l FROM documents),
r AS (SELECT doc, page, unnest(l) AS line, generate_subscripts(l, 1) AS pos, l FROM l),
f AS (SELECT doc, page, pos, regexp_extract(line, '^([A-Z][a-z]+)\.$', 1) AS number, coalesce(list_filter(l[pos + 1:pos + 5], lambda x: x <> '' AND NOT regexp_matches(x, '^[0-9]+$|^[A-Z][a-z]+\.$|^\([a-z]\)|^[0-9]+–[0-9]+–[0-9]+')
  AND x NOT IN ('CS-E', 'BOOK', 'AMC', 'Annex'))[1], '') AS t FROM r WHERE regexp_matches(line, '^([A-Z][a-z]+)\.$')),
k AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(t, '\s*-\s*$', ''), '\.{3,}$', ''), '\s+', ' ', 'g')) AS title FROM f)
SELECT doc, number, arg_min(title, (page, pos)) AS title, arg_min(page, (page, pos)) AS page FROM k WHERE length(title) > 2 GROUP BY doc, number""".replace("STRIPPED", STRIP.format("x"))


@query("sections_from_pages_ahead", AHEAD)
def sections_from_pages_ahead(t):
    pages = t("documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text")
    return st.sections_from_pages(pages, "^(no header form)(.)$", r"^([A-Z][a-z]+)\.$", ahead=5)


@query(
    "locate_ranges",
    f"""WITH {SECTIONS}, sub AS (SELECT doc, node_id AS name, page AS hint, lower(string_split(title, ' ')[1]) AS marker FROM sections),
pg AS (SELECT doc, page, text FROM sections),
s AS (SELECT sub.doc, name, min(pg.page) AS start FROM sub JOIN pg ON pg.doc = sub.doc AND pg.page BETWEEN hint - 5 AND hint + 50 AND contains(pg.text, marker) GROUP BY sub.doc, name)
SELECT doc, name, start, coalesce(lead(start) OVER (PARTITION BY doc ORDER BY start, name) - 1, -1) AS "end" FROM s""",
)
def locate_ranges(t):
    s = t.sections()
    sub = s.select(
        "doc", F.col("node_id").alias("name"), F.col("page").alias("hint"), F.lower(F.split("title", " ")[0]).alias("marker")
    )
    return st.locate_ranges(sub, s.select("doc", "page", "text")).withColumn("end", F.coalesce("end", F.lit(-1)))


@query(
    "section_number",
    r"""SELECT doc_id, coalesce(nullif(regexp_extract(text, '第\s*([0-9.]+)\s*条', 1), ''), nullif(regexp_extract(text, '§\s*([0-9]+(?:\.[0-9]+)*)', 1), ''),
nullif(regexp_extract(text, '([A-Z]\.[0-9]+|[0-9]+\.[0-9]+[a-z]?)', 1), '')) AS number FROM documents""",
)
def section_number(t):
    return t.docs().select("doc_id", tx.section_number(F.col("text")).alias("number"))


@query(
    "section_fulltext",
    f"""WITH {SECTIONS}, r AS (SELECT doc || ':' || number AS key, ordinal,
  trim(concat_ws(' ', nullif(summary, ''), array_to_string(content_parts, ' '))) AS fulltext FROM sections)
SELECT key, arg_max(fulltext, ordinal) AS fulltext FROM r WHERE fulltext <> '' GROUP BY key""",
)
def section_fulltext(t):
    return st.section_fulltext(t.sections())


@query(
    "lookup_section",
    f"""WITH {SECTIONS}, s AS (SELECT doc, node_id, ordinal, number || ' ' || title AS title FROM sections), w AS (SELECT DISTINCT doc, number FROM sections)
SELECT w.doc, w.number, arg_min(node_id, ordinal) AS node_id, arg_min(title, ordinal) AS title FROM w JOIN s ON s.doc = w.doc AND contains(s.title, w.number) GROUP BY w.doc, w.number""",
)
def lookup_section(t):
    s = t.sections()
    named = s.withColumn("title", F.concat_ws(" ", "number", "title"))
    return st.lookup_section(named, s.select("doc", "number").distinct())


@query(
    "document_stats",
    f"""WITH {SECTIONS} SELECT doc, count(*) AS sections, max(page) AS pages, count(*) FILTER (len(content_parts) > 0) AS with_content, sum(length(text))::BIGINT AS characters
FROM sections GROUP BY doc""",
)
def document_stats(t):
    return st.document_stats(t.sections())


@query("list_sections", f"WITH {SECTIONS} SELECT doc, number, title, page FROM sections WHERE contains(title, 'th') AND contains(title, 'on')")
def list_sections(t):
    return st.list_sections(t.sections(), ["th", "on"])


@query(
    "tree_paths",
    """WITH RECURSIVE n AS (
  SELECT 'r' || r_regionkey AS id, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders),
p AS (SELECT id, id AS path, 1 AS depth FROM n WHERE parent IS NULL UNION ALL SELECT n.id, p.path || '>' || n.id, p.depth + 1 FROM n JOIN p ON n.parent = p.id)
SELECT id, path, depth::BIGINT AS depth FROM p""",
)
def tree_paths(t):
    return st.tree_paths(star_tree(t)).select("id", F.array_join("path", ">").alias("path"), F.col("depth").cast("long"))


def star_tree(t: Tables):
    def level(table, key, prefix, parent=None, parent_prefix=""):
        up = F.concat(F.lit(parent_prefix), F.col(parent)) if parent else F.lit(None).cast("string")
        return t(table).select(F.concat(F.lit(prefix), F.col(key)).alias("id"), up.alias("parent"))

    return (
        level("region", "r_regionkey", "r").union(level("nation", "n_nationkey", "n", "n_regionkey", "r"))
        .union(level("customer", "c_custkey", "c", "c_nationkey", "n")).union(level("orders", "o_orderkey", "o", "o_custkey", "c"))
    )


HEADERS = f"""{SECTIONS}, headers AS (SELECT doc, CASE WHEN doc LIKE '%1%' THEN count(*) END AS total_sections,
  CASE WHEN doc LIKE '%2%' THEN 'X' WHEN doc LIKE '%3' THEN NULL WHEN doc LIKE '%4' THEN 'B' ELSE 'A' END AS layout,
  CASE WHEN doc LIKE '%5%' THEN 'FAA' END AS agency, CASE WHEN doc LIKE '%6' THEN max(page) END AS pages,
  count(*) FILTER (contains(title, 'zq')) AS found FROM sections GROUP BY doc)"""


def headers(t: Tables):
    d = F.col("doc")
    return t.sections().groupBy("doc").agg(
        F.count("*").alias("n"), F.max("page").alias("p"), F.count_if(F.col("title").contains("zq")).alias("found")
    ).select(
        "doc", F.when(d.contains("1"), F.col("n")).alias("total_sections"),
        F.when(d.contains("2"), "X").when(d.endswith("3"), None).when(d.endswith("4"), "B").otherwise("A").alias("layout"),
        F.when(d.contains("5"), "FAA").alias("agency"), F.when(d.endswith("6"), F.col("p")).alias("pages"), "found",
    )


@query(
    "parse_issues",
    f"""WITH {HEADERS} SELECT doc, concat_ws(',', CASE WHEN coalesce(total_sections, 0) = 0 THEN 'missing_total' END, CASE WHEN layout IS NULL THEN 'missing_structure' END,
  CASE WHEN layout NOT IN ('A', 'B') THEN 'bad_layout' END, CASE WHEN found = 0 THEN 'no_sections' END) AS issues FROM headers""",
)
def parse_issues(t):
    return st.parse_issues(headers(t)).select("doc", F.array_join("issues", ",").alias("issues"))


@query(
    "repair_headers",
    f"""WITH {HEADERS}, c AS (SELECT doc, count(*) FILTER (regexp_matches(title, 'th|qu')) AS counted FROM sections GROUP BY doc),
f AS (SELECT doc, coalesce(nullif(total_sections, 0), counted, 0) AS total_sections, coalesce(agency, 'OTHER') AS agency, coalesce(pages, 0)::BIGINT AS pages FROM headers LEFT JOIN c USING (doc))
SELECT *, CASE WHEN total_sections >= 301 THEN 'excellent' WHEN total_sections >= 101 THEN 'good' ELSE 'partial' END AS parse_quality FROM f""",
)
def repair_headers(t):
    out = st.repair_headers(headers(t).select("doc", "total_sections", "agency", "pages"), t.sections(), "th|qu")
    return out.select("doc", "total_sections", "agency", "pages", "parse_quality")


@query("fill_summaries", f"WITH {SECTIONS} SELECT node_id, CASE WHEN length(summary) < 5 THEN substr(title, 1, 100) ELSE summary END AS summary FROM sections")
def fill_summaries(t):
    return st.fill_summaries(t.sections()).select("node_id", "summary")


@query(
    "expanded_content",
    f"""WITH {SECTIONS}, e AS (SELECT *, len(content_parts) > 0 AND length(summary) + length(array_to_string(content_parts, '')) < 500 AS expanded FROM sections)
SELECT node_id, expanded, CASE WHEN expanded THEN concat_ws(chr(10), nullif(summary, ''), array_to_string(content_parts, chr(10))) ELSE summary END AS content FROM e""",
)
def expanded_content(t):
    return st.expanded_content(t.sections()).select("node_id", "expanded", "content")
