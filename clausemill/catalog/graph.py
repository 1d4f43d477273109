"""Graph building and graph queries: sections of the documents, link graph of the pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.catalog.base import GRAPH, SECTIONS, Tables, query
from clausemill.catalog.rules import any_sql
from clausemill.catalog.structure import STRIP
from clausemill.functions import text as tx
from clausemill.operators import graph_build as gb
from clausemill.operators import graph_query as gq

PATTERNS = [("component", "([a-z]+keit)"), ("component", "([a-z]+ment) "), ("test", "(T[a-z]+tion)"), ("parameter", r"([0-9]+)\s*[$%#]")]
EDGE_TYPES = {"component": "CONSTRAINS", "test": "REQUIRES_TEST", "parameter": "SPECIFIES"}


def hits_sql(source: str, cols: str, text: str = "text") -> str:
    return " UNION ALL ".join(f"SELECT {cols}, '{k}' AS type, unnest(regexp_extract_all({text}, '{p}', 1)) AS name FROM {source}" for k, p in PATTERNS)


ENT = f"""hits AS ({hits_sql('sections', 'node_id, ordinal')}),
ents AS (SELECT type || ':' || md5(name) AS id, type, name AS label, arg_min(node_id, ordinal) AS first_seen, count(*) AS mentions FROM hits GROUP BY type, name)"""


@query("extract_entities", f"WITH {SECTIONS}, {ENT} SELECT * FROM ents")
def extract_entities(t):
    return gb.extract_entities(t.sections(), PATTERNS)


PARAMETER = r"([0-9]+\.[0-9]+|[0-9]+[$%#])"


@query(
    "parameter_entities",
    rf"""WITH {SECTIONS}, v AS (SELECT DISTINCT node_id, ordinal, text, unnest(regexp_extract_all(text, '{PARAMETER}', 1)) AS value FROM sections),
c AS (SELECT *, strpos(text, value) AS p FROM v),
x AS (SELECT node_id, ordinal, value, {STRIP.format("regexp_extract(substr(text, greatest(p - 20, 1), least(20, p - 1)), '[^\n]*$') || value || regexp_extract(substr(text, p + length(value), 20), '^[^\n]*')")} AS context FROM c)
SELECT 'parameter:' || md5(value) AS id, value AS label, arg_min(context, (ordinal, node_id)) AS context, arg_min(node_id, (ordinal, node_id)) AS first_seen, count(*) AS mentions FROM x GROUP BY value""",
)
def parameter_entities(t):
    return gb.parameter_entities(t.sections(), PARAMETER)


HEADER = "([A-Z][a-z]+) [a-z]+ [a-z]+[.][ ]*\n"


@query(
    "extract_relations",
    f"""WITH {SECTIONS}, {ENT}, l AS (SELECT node_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos, len(l) AS n FROM (SELECT node_id, string_split(text, chr(10)) AS l FROM sections)),
h AS (SELECT *, CASE WHEN pos < n THEN nullif(regexp_extract(line, '^([A-Z][a-z]+) [a-z]+ [a-z]+[.][ ]*$', 1), '') END AS key FROM l),
g AS (SELECT *, max(CASE WHEN key IS NOT NULL THEN pos END) OVER (PARTITION BY node_id ORDER BY pos) AS hp FROM h),
b AS (SELECT g.node_id || coalesce('#' || k.key, '') AS src, g.node_id, string_agg(g.line, chr(10) ORDER BY g.pos) AS body FROM g LEFT JOIN h k ON k.node_id = g.node_id AND k.pos = g.hp
   WHERE g.key IS NULL GROUP BY g.node_id, g.hp, k.key),
r AS ({hits_sql('b', 'src', 'body')})
SELECT DISTINCT src, type || ':' || md5(name) AS dst, CASE type WHEN 'component' THEN 'CONSTRAINS' WHEN 'test' THEN 'REQUIRES_TEST' ELSE 'SPECIFIES' END AS type FROM r""",
)
def extract_relations(t):
    nodes = gb.extract_entities(t.sections(), PATTERNS)
    return gb.extract_relations(t.sections(), nodes, PATTERNS, EDGE_TYPES, HEADER)


SIMPLE = {"component": ["tion", "keit"], "test": ["Test", "ing the"]}
VALUE = r"([a-z]+) = .([0-9a-f]{4})"
_S = " UNION ALL ".join(f"SELECT node_id, '{k}' AS type, '{w}' AS name FROM sections WHERE contains(text, '{w}')" for k, ws in SIMPLE.items() for w in ws)
_S += f" UNION SELECT node_id, 'parameter', a || ' ' || b FROM (SELECT node_id, unnest(regexp_extract_all(text, '{VALUE}', 1)) AS a, unnest(regexp_extract_all(text, '{VALUE}', 2)) AS b FROM sections)"


@query("extract_simple", f"WITH {SECTIONS}, f AS ({_S}) SELECT DISTINCT node_id AS src, type || ':' || md5(name) AS dst, 'MENTIONS' AS type FROM f")
def extract_simple(t):
    return gb.extract_simple(t.sections(), SIMPLE, VALUE)[1]


SG = f"""{SECTIONS}, ch AS (SELECT doc, letter, ordinal, doc || ':' || letter || CASE WHEN n > 1 THEN '_' || n ELSE '' END AS id, n FROM (
  SELECT 'src' || (s_suppkey % 20) AS doc, chr((65 + s_nationkey % 8)::INT) AS letter, s_suppkey AS ordinal, row_number() OVER (PARTITION BY s_suppkey % 20, s_nationkey % 8 ORDER BY s_suppkey) AS n FROM supplier)),
s AS (SELECT doc, node_id, title, chr((65 + page % 9)::INT) AS letter FROM sections),
sgn AS (SELECT doc AS id, 'document' AS type, doc AS label FROM (SELECT doc FROM s UNION SELECT doc FROM ch) UNION ALL SELECT id, 'chapter', letter FROM ch UNION ALL SELECT node_id, 'section', title FROM s),
sge AS (SELECT doc AS src, id AS dst, 'contains' AS type FROM ch UNION ALL SELECT coalesce(c.id, s.doc), s.node_id, 'contains' FROM s LEFT JOIN ch c ON c.doc = s.doc AND c.letter = s.letter AND c.n = 1)"""


def section_graph(t: Tables):
    ch = t("supplier").select(F.concat(F.lit("src"), F.col("s_suppkey") % 20).alias("doc"), F.char(65 + F.col("s_nationkey") % 8).alias("letter"), F.col("s_suppkey").alias("ordinal"))
    return gb.section_graph(t.sections().withColumn("letter", F.char(65 + F.col("page") % 9)), ch)


@query("section_graph_nodes", f"WITH {SG} SELECT id, type, label FROM sgn")
def section_graph_nodes(t):
    return section_graph(t)[0]


@query("section_graph_edges", f"WITH {SG} SELECT src, dst, type FROM sge")
def section_graph_edges(t):
    return section_graph(t)[1]


COMP = {"engine": "gine|tion", "gear": "keit|ger", "fire": "feu|fire"}
_F = " UNION ALL ".join(
    ["SELECT node_id, 'requirement' AS kind, 'yes' AS value FROM sections WHERE regexp_matches(text, 'shall|that')"]
    + [f"SELECT node_id, 'component', '{k}' FROM sections WHERE regexp_matches(text, '{p}')" for k, p in COMP.items()]
    + [r"SELECT node_id, 'percent', unnest(regexp_extract_all(text, '\d+[%#$]')) FROM sections", r"SELECT node_id, 'duration', unnest(regexp_extract_all(text, '\d{2,}\.\d+')) FROM sections",
       "SELECT node_id, 'condition', 'yes' FROM sections WHERE regexp_matches(text, ' if | que ')", "SELECT node_id, 'reference', unnest(regexp_extract_all(text, '[A-Z][a-z]+ion')) FROM sections"])


@query("section_facets", f"WITH {SECTIONS} {_F}")
def section_facets(t):
    return gb.section_facets(t.sections(), "shall|that", COMP, r"\d+[%#$]", r"\d{2,}\.\d+", " if | que ", "[A-Z][a-z]+ion")


@query(
    "keyword_mentions",
    f"WITH {SECTIONS} " + " UNION ALL ".join(f"SELECT node_id AS src, '{k}:{w}' AS dst, 'mentions' AS type, 0.5::DOUBLE AS weight FROM sections WHERE contains(text, '{w}')" for k, ws in SIMPLE.items() for w in ws),
)
def keyword_mentions(t):
    return gb.keyword_mentions(t.sections(), SIMPLE)


VALS = {"mark": r"(\d+)\s*[#&]", "dotted": r"(\d+)\.\d"}


@query(
    "value_nodes",
    f"WITH {SECTIONS} " + " UNION ALL ".join(
        f"SELECT node_id AS src, 'value:{k}:' || unnest(list_distinct(regexp_extract_all(text, '{p}', 1))) AS dst, 'specifies' AS type, 0.3::DOUBLE AS weight FROM sections" for k, p in VALS.items()),
)
def value_nodes(t):
    return gb.value_nodes(t.sections(), VALS)


@query(
    "follows_edges",
    """SELECT 'o' || o_orderkey AS src, 'o' || nxt AS dst, 'follows' AS type, 0.2::DOUBLE AS weight FROM (
SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, 'o' || o_orderkey) AS nxt FROM orders) WHERE nxt IS NOT NULL""",
)
def follows_edges(t):
    o = t("orders").select(F.col("o_custkey").alias("cust"), "o_orderdate", F.concat(F.lit("o"), "o_orderkey").alias("node"))
    return gb.follows_edges(o, "cust", ["o_orderdate"], "node", F.year("o_orderdate"))


@query(
    "equivalent_by_label",
    f"""WITH {SECTIONS}, f AS (SELECT number, min(node_id) AS src FROM sections GROUP BY number)
SELECT src, node_id AS dst, 'equivalent_to' AS type, 0.8::DOUBLE AS weight FROM sections JOIN f USING (number) WHERE src <> node_id""",
)
def equivalent_by_label(t):
    return gb.equivalent_by_label(t.sections())


def star_doc_sql(members: str, group: str, node: str, doc: str) -> str:
    return f"""a1 AS (SELECT {group}, min({node}) AS f, arg_min({doc}, {node}) AS fd FROM {members} GROUP BY {group}),
a2 AS (SELECT {group}, min({node}) AS s FROM {members} JOIN a1 USING ({group}) WHERE {doc} <> fd GROUP BY {group}),
star AS (SELECT DISTINCT {group}, least(x, {node}) AS src, greatest(x, {node}) AS dst FROM (SELECT {group}, {node}, CASE WHEN {doc} = fd THEN s ELSE f END AS x FROM {members} JOIN a1 USING ({group}) JOIN a2 USING ({group})))"""


@query(
    "equivalent_across_documents",
    f"WITH {SECTIONS}, m AS (SELECT number, node_id, doc FROM sections), {star_doc_sql('m', 'number', 'node_id', 'doc')} SELECT src, dst, 'equivalent_to' AS type, 0.9::DOUBLE AS weight FROM star",
)
def equivalent_across_documents(t):
    return gb.equivalent_by_label(t.sections(), other_documents=True)


@query(
    "equivalent_from_table",
    f"""WITH {GRAPH} SELECT DISTINCT p_src AS src, p_dst AS dst, 'equivalent_to' AS type FROM (
SELECT 'page:' || p_partkey AS p_src, 'word:' || string_split(p_name, ' ')[1] AS p_dst FROM part UNION ALL SELECT 'page:' || page_id, 'word:' || lower(regexp_extract(html, 'href="/([^"]*)"', 1)) FROM pages)
WHERE p_src IN (SELECT id FROM nodes) AND p_dst IN (SELECT id FROM nodes)""",
)
def equivalent_from_table(t):
    pairs = t("part").select(F.concat(F.lit("page:"), "p_partkey").alias("src"), F.concat(F.lit("word:"), F.split("p_name", " ")[0]).alias("dst")).union(
        t("pages").select(F.concat(F.lit("page:"), "page_id"), F.concat(F.lit("word:"), F.lower(F.regexp_extract("html", r'href="/([^"]*)"', 1)))))
    return gb.equivalent_from_table(pairs, t.graph()[0])


TOPICS = {"motion": ["tion", "ing"], "state": ["ment", "heit"], "link": ["que", "und"]}
TOPIC_CASE = "CASE " + " ".join(f"WHEN {any_sql('title', w)} THEN '{k}'" for k, w in TOPICS.items()) + " END"


@query(
    "topic_links",
    f"""WITH {SECTIONS}, k AS (SELECT node_id, {TOPIC_CASE} AS topic FROM sections), f AS (SELECT topic, min(node_id) AS src FROM k WHERE topic IS NOT NULL GROUP BY topic)
SELECT src, node_id AS dst, topic, 0.6::DOUBLE AS weight FROM k JOIN f USING (topic) WHERE src <> node_id""",
)
def topic_links(t):
    return gb.topic_links(t.sections(), TOPICS)


@query(
    "topic_window_pairs",
    f"""WITH {SECTIONS}, k AS (SELECT node_id, topic, row_number() OVER (PARTITION BY topic ORDER BY ordinal) AS rn FROM (SELECT node_id, ordinal, {TOPIC_CASE} AS topic FROM sections) WHERE topic IS NOT NULL),
f AS (SELECT number, min(node_id) AS src FROM sections GROUP BY number), e AS (SELECT src, node_id AS dst FROM sections JOIN f USING (number) WHERE src <> node_id)
SELECT a.node_id AS src, b.node_id AS dst, 'same_topic' AS type, 0.5::DOUBLE AS weight FROM k a JOIN k b ON a.topic = b.topic AND b.rn BETWEEN a.rn + 1 AND a.rn + 7
WHERE NOT EXISTS (SELECT 1 FROM e WHERE (e.src = a.node_id AND e.dst = b.node_id) OR (e.src = b.node_id AND e.dst = a.node_id))""",
)
def topic_window_pairs(t):
    return gb.topic_window_pairs(t.sections(), TOPICS, gb.equivalent_by_label(t.sections()), slice_rows=100)


@query(
    "refines_edges",
    f"""WITH {SECTIONS}, s AS (SELECT doc, number, node_id FROM sections UNION ALL SELECT doc, string_split(number, '.')[1], 'chap:' || node_id FROM sections WHERE contains(title, 'tion'))
SELECT a.node_id AS src, b.node_id AS dst, 'refines' AS type FROM s a JOIN s b ON a.doc = b.doc AND starts_with(a.number, b.number || '.')""",
)
def refines_edges(t):
    s = t.sections()
    chap = s.filter(F.col("title").contains("tion")).select("doc", F.split("number", r"\.")[0].alias("number"), F.concat(F.lit("chap:"), "node_id").alias("node_id"))
    return gb.refines_edges(s.select("doc", "number", "node_id").union(chap))


@query("reference_edges", "SELECT DISTINCT 'page:' || page_id AS src, 'ref:' || unnest(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1)) AS dst, 'references' AS type FROM pages")
def reference_edges(t):
    p = t("pages").select(F.concat(F.lit("page:"), "page_id").alias("node_id"), F.col("html").alias("text"))
    return gb.reference_edges(p, r'href="/([^"]*)"')


REFS = {"link": 'href="[^"]*"', "tag": "<h1>", "entity": "&[a-z]+;"}


@query(
    "clause_references",
    "WITH r AS (SELECT 'page:' || page_id AS node_id, [" + ", ".join(f"{{'kind': '{k}', 'v': regexp_extract_all(html, '{p}')}}" for k, p in REFS.items()) + """] AS k FROM pages),
f AS (SELECT node_id, flatten(list_transform(k, lambda x: list_transform(x.v, lambda v: {'kind': x.kind, 'value': v}))) AS l FROM r)
SELECT node_id, len(l) AS reference_count, generate_subscripts(l, 1) - 1 AS pos, unnest(l).kind AS kind, unnest(l).value AS value FROM f""",
)
def clause_references(t):
    p = t("pages").select(F.concat(F.lit("page:"), "page_id").alias("node_id"), F.col("html").alias("text"))
    return gb.clause_references(p, REFS).withColumn("pos", F.col("pos").cast("long"))


@query(
    "dependency_contexts",
    r"""WITH m AS (SELECT doc_id, text, regexp_extract_all(text, 'of [a-z]+ the') AS h, list_transform(regexp_split_to_array(text, 'of [a-z]+ the'), lambda g: length(g)) AS gp FROM documents),
p AS (SELECT doc_id, text, len(h) AS n, i, list_sum(gp[1:i]) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS st, length(h[i]) AS ln FROM m, range(1, 2000) r(i) WHERE i <= greatest(len(h), 1))
SELECT doc_id::VARCHAR AS node_id, n = 0 AS root, CASE WHEN n = 0 THEN -1 ELSE i - 1 END::BIGINT AS pos,
  coalesce(CASE WHEN n > 0 THEN regexp_replace(substr(text, (greatest(st - 50, 0) + 1)::BIGINT, (ln + 50 + least(st, 50))::BIGINT), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') END, '') AS context FROM p""",
)
def dependency_contexts(t):
    d = t.docs().select(F.col("doc_id").cast("string").alias("node_id"), "text")
    out = gb.dependency_contexts(d, ["of [a-z]+ the"])
    return out.select("node_id", "root", F.coalesce("pos", F.lit(-1)).cast("long").alias("pos"), F.coalesce("context", F.lit("")).alias("context"))


@query(
    "test_edges",
    f"""WITH {SECTIONS}, e AS (SELECT node_id AS dst, unnest(list_filter(['tion', 'ment', 'ing'], lambda w: contains(title, w))) AS part FROM sections WHERE contains(title, 'th') OR contains(title, 'que')),
rq AS (SELECT DISTINCT 'req:' || w AS id, w AS word FROM (SELECT unnest(regexp_extract_all(text, '[a-z]{{6,}}')) AS w FROM benchmark)),
n AS (SELECT id, node_id, row_number() OVER (PARTITION BY id ORDER BY ordinal) AS rn FROM rq JOIN sections ON contains(title, word))
SELECT 'part:' || part AS src, dst, 'tested_by' AS type, 0.9::DOUBLE AS weight FROM e UNION ALL SELECT id, node_id, 'verified_by', 0.7::DOUBLE FROM n WHERE rn <= 5""",
)
def test_edges(t):
    w = t("benchmark").select(F.explode(tx.matches(F.col("text"), "[a-z]{6,}")).alias("word")).distinct()
    return gb.test_edges(t.sections(), ["th", "que"], ["tion", "ment", "ing"], w.select(F.concat(F.lit("req:"), "word").alias("id"), "word"))


CHAINS = {"causes": ["word:the", "word:of", "word:and"], "leads_to": ["word:la", "word:de", "word:nowhere"]}


@query(
    "static_edges",
    f"WITH {GRAPH}, c(src, dst, type) AS (VALUES {', '.join(str(r) for r in gb.chain_edges(CHAINS))}) SELECT src, dst, type FROM c WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)",
)
def static_edges(t):
    return gb.static_edges(t.rows("src string, dst string, type string", gb.chain_edges(CHAINS)), t.graph()[0])


@query(
    "normalise_edge_types",
    f"WITH {GRAPH}, e AS (SELECT src, dst, CASE WHEN length(dst) % 2 = 0 THEN 'references' ELSE type END AS type FROM edges) SELECT src, dst, type = 'references' AS changed, CASE type WHEN 'references' THEN 'cross_references' ELSE type END AS type FROM e",
)
def normalise_edge_types(t):
    e = t.graph()[1].withColumn("type", F.when(F.length("dst") % 2 == 0, "references").otherwise(F.col("type")))
    return gb.normalise_edge_types(e)


RULES = [(1, "src1", "5", "src2", "12", "equivalent_to"), (2, "src3", "83", "src3", "3", "refers_to"), (3, "src9", "9", "src4", "4", "equivalent_to")]


@query(
    "rule_edges",
    f"""WITH {SECTIONS}, r(rule, sd, sn, dd, dn, type) AS (VALUES {', '.join(str(x) for x in RULES)}),
n AS (SELECT node_id AS id, doc, regexp_replace(node_id, '[^0-9]', '', 'g') AS digits FROM sections),
l AS (SELECT rule, type, id FROM r JOIN n ON n.doc = sd AND contains(digits, sn)), q AS (SELECT rule, type, id FROM r JOIN n ON n.doc = dd AND contains(digits, dn)),
p AS (SELECT l.id AS src, f.f AS dst, l.type FROM l JOIN (SELECT rule, min(id) AS f FROM q GROUP BY rule) f USING (rule) UNION SELECT f.f, q.id, q.type FROM q JOIN (SELECT rule, min(id) AS f FROM l GROUP BY rule) f USING (rule)),
m AS (SELECT number, node_id, doc FROM sections), {star_doc_sql('m', 'number', 'node_id', 'doc')}
SELECT src, dst, type FROM p WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM star WHERE p.type = 'equivalent_to' AND star.src = least(p.src, p.dst) AND star.dst = greatest(p.src, p.dst))""",
)
def rule_edges(t):
    rules = t.rows("rule int, src_doc string, src_number string, dst_doc string, dst_number string, type string", RULES)
    nodes = t.sections().select(F.col("node_id").alias("id"), "doc")
    return gb.rule_edges(nodes, rules, gb.equivalent_by_label(t.sections(), other_documents=True))


WORDS = {"heit": "shares_state", "queaux": "shares_link", "thing": "shares_thing"}
_W = " UNION ALL ".join(f"SELECT node_id AS id, doc, '{w}:{k}' AS g FROM sections WHERE contains(lower(node_id || ' ' || title), '{w}')" for w, k in WORDS.items())


@query(
    "cross_document_links",
    f"WITH {SECTIONS}, m AS ({_W}), {star_doc_sql('m', 'g', 'id', 'doc')} SELECT src, dst, string_split(g, ':')[2] AS type, string_split(g, ':')[1] AS word FROM star",
)
def cross_document_links(t):
    return gb.cross_document_links(t.sections().select(F.col("node_id").alias("id"), "doc", F.col("title").alias("label")), WORDS)


@query(
    "attach_isolated",
    rf"""WITH {GRAPH}, n AS (SELECT id, lower(type) AS type, 'd' || (length(label) % 5) AS doc, label FROM nodes WHERE id LIKE 'page:%'), e AS (SELECT src, dst FROM edges WHERE contains(dst, 'th')),
lone AS (SELECT * FROM n WHERE id NOT IN (SELECT src FROM e)), w AS (SELECT id, unnest(list_distinct(regexp_extract_all(lower(label), '\S+'))) AS w FROM n),
s AS (SELECT a.id AS iso, b.id, count(*) AS c FROM w a JOIN w b USING (w) WHERE a.id IN (SELECT id FROM lone) AND a.id <> b.id GROUP BY ALL),
p AS (SELECT l.id AS src, n.id AS dst, l.type AS lt, (CASE WHEN l.doc = n.doc THEN 5 ELSE 0 END + coalesce(c, 0) * 2 + CASE WHEN l.type = n.type THEN 3 ELSE 0 END)::BIGINT AS score FROM lone l JOIN n ON n.id <> l.id LEFT JOIN s ON s.iso = l.id AND s.id = n.id)
SELECT src, dst, 'cross_references' AS type, score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rn FROM p WHERE score > 0) WHERE rn <= 3""",
)
def attach_isolated(t):
    nodes, edges = t.graph()
    pages = nodes.filter("id like 'page:%'").select("id", F.lower("type").alias("type"), F.concat(F.lit("d"), F.length("label") % 5).alias("doc"), "label")
    return gb.attach_isolated(pages, edges.filter("contains(dst, 'th')"))


@query(
    "attach_isolated_hub",
    rf"""WITH {SECTIONS}, n AS (SELECT node_id AS id, doc, lang AS type, title AS label FROM sections),
lone AS (SELECT * FROM n), w AS (SELECT id, unnest(list_distinct(regexp_extract_all(lower(label), '[a-z]{{6,}}'))) AS w FROM n),
s AS (SELECT a.id AS iso, b.id, count(*) AS c FROM w a JOIN w b USING (w) WHERE a.id <> b.id GROUP BY ALL),
p AS (SELECT l.id AS src, n.id AS dst, (CASE WHEN l.doc = n.doc THEN 5 ELSE 0 END + coalesce(c, 0) * 2 + CASE WHEN l.type = n.type THEN 3 ELSE 0 END)::BIGINT AS score
  FROM lone l JOIN n ON n.id <> l.id LEFT JOIN s ON s.iso = l.id AND s.id = n.id),
b AS (SELECT src, dst, 'cross_references' AS type, score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rn FROM p WHERE score >= 14) WHERE rn <= 3),
h AS (SELECT doc, min(id) AS hub FROM n GROUP BY doc)
SELECT * FROM b UNION ALL SELECT id, hub, 'belongs_to', 0 FROM lone JOIN h USING (doc) WHERE id <> hub AND id NOT IN (SELECT src FROM b)""",
)
def attach_isolated_hub(t):
    """Sections with words of their titles, none linked yet; those without a candidate of 14 points go to their document's hub."""
    nodes = t.sections().select(F.col("node_id").alias("id"), "doc", F.col("lang").alias("type"), F.col("title").alias("label"))
    return gb.attach_isolated(nodes, t.graph()[1], word="[a-z]{6,}", least=14)


@query("dedupe_edges", f"WITH {GRAPH} SELECT src, dst, 'LINK' AS type FROM links GROUP BY ALL")
def dedupe_edges(t):
    return gb.dedupe_edges(t.links().withColumn("type", F.lit("LINK")))


LINES = r"""sections AS (SELECT source || ':' || doc_id AS section_id, source AS chapter_id, doc_id, text FROM documents),
para AS (SELECT section_id || '/' || (i - 1) AS paragraph_id, section_id, l[i] AS content FROM (SELECT section_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM sections)),
ent AS (SELECT DISTINCT paragraph_id, unnest(regexp_extract_all(content, '[A-Z][a-z]{6,}')) AS name FROM para),
ref AS (SELECT DISTINCT paragraph_id, unnest(regexp_extract_all(content, '[0-9]{3,}')) AS name FROM para),
cited AS (SELECT section_id AS source, regexp_replace(section_id, '[0-9]+$', '') || (doc_id + 20) AS target FROM sections),
defs AS (SELECT n_name AS name, 'country' AS kind, 'src' || n_nationkey || ':' || n_nationkey AS section_id FROM nation)"""


def line_parts(t: Tables):
    d = t("documents").select(F.concat_ws(":", "source", "doc_id").alias("section_id"), F.col("source").alias("chapter_id"), "doc_id", "text")
    para = d.select("section_id", F.posexplode(F.split("text", "\n")).alias("i", "content")).select(F.concat_ws("/", "section_id", "i").alias("paragraph_id"), "section_id", "content")
    names = lambda pattern: para.select("paragraph_id", F.explode(F.array_distinct(tx.matches(F.col("content"), pattern))).alias("name"))
    cited = d.select(F.col("section_id").alias("source"), F.concat(F.regexp_replace("section_id", "[0-9]+$", ""), F.col("doc_id") + 20).alias("target"))
    defined = t("nation").select(F.col("n_name").alias("name"), F.lit("country").alias("entity_type"), F.concat(F.lit("src"), "n_nationkey", F.lit(":"), "n_nationkey").alias("section_id"))
    chapters = d.select("chapter_id", F.lit("chapter").alias("title")).distinct()
    return gb.graph_from_parts(chapters, d.select("section_id", "chapter_id", F.lit("section").alias("title")), para, names("[A-Z][a-z]{6,}"), names("[0-9]{3,}"), defined, cited)


@query(
    "parts_nodes",
    f"""WITH {LINES} SELECT DISTINCT chapter_id AS id, 'Chapter' AS type, 'chapter' AS label FROM sections UNION ALL SELECT section_id, 'Section', 'section' FROM sections
UNION ALL SELECT paragraph_id, 'Paragraph', substr(content, 1, 500) FROM para UNION ALL SELECT DISTINCT 'entity:' || name, 'concept', name FROM ent WHERE name NOT IN (SELECT name FROM defs)
UNION ALL SELECT DISTINCT 'reference:' || name, 'Reference', name FROM ref UNION ALL SELECT 'entity:' || name, kind, name FROM defs""",
)
def parts_nodes(t):
    return line_parts(t)[0]


@query(
    "parts_edges",
    f"""WITH {LINES} SELECT chapter_id AS src, section_id AS dst, 'HAS_SECTION' AS type FROM sections UNION ALL SELECT section_id, paragraph_id, 'HAS_PARAGRAPH' FROM para
UNION ALL SELECT paragraph_id, 'entity:' || name, 'MENTIONS' FROM ent UNION ALL SELECT paragraph_id, 'reference:' || name, 'REFERS_TO' FROM ref
UNION ALL SELECT section_id, 'entity:' || name, 'DEFINES' FROM defs WHERE section_id IN (SELECT section_id FROM sections)
UNION ALL SELECT source, target, 'REFERS_TO' FROM cited WHERE target IN (SELECT section_id FROM sections)""",
)
def parts_edges(t):
    return line_parts(t)[1]


@query(
    "merge_nodes",
    f"""WITH {GRAPH}, {SECTIONS}, a AS (SELECT 0 AS o, id, type, label FROM nodes UNION ALL SELECT 1, 'page:' || ordinal, 'Paragraph', title FROM sections UNION ALL SELECT 2, 'page:' || p_partkey, p_type, p_name FROM part)
SELECT id, type, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o DESC) AS rn FROM a) WHERE rn = 1""",
)
def merge_nodes(t):
    s = t.sections().select(F.concat(F.lit("page:"), "ordinal").alias("id"), F.lit("Paragraph").alias("type"), F.col("title").alias("label"))
    p = t("part").select(F.concat(F.lit("page:"), "p_partkey").alias("id"), F.col("p_type").alias("type"), F.col("p_name").alias("label"))
    return gb.merge_nodes([t.graph()[0], s, p])


KEYWORDS = ["the", "Que", "keit"]


@query(
    "keyword_edges",
    f"""WITH {GRAPH}, k AS (SELECT unnest({[k.lower() for k in KEYWORDS]}) AS keyword),
h AS (SELECT DISTINCT keyword, src, dst, e.type FROM edges e JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst, k WHERE contains(lower(a.label), keyword) OR contains(lower(b.label), keyword))
SELECT keyword, src, dst, type FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY src, dst, type) AS rn FROM h) WHERE rn <= 20""",
)
def keyword_edges(t):
    nodes, edges = t.graph()
    return gq.keyword_edges(KEYWORDS, nodes, edges, limit=20).drop("rank")


FAM = "CASE WHEN lower({0}) IN ('chapter', 'section', 'regulation', 'requirement', 'clause') THEN 'regulation' WHEN lower({0}) IN ('component', 'rotorpart', 'statorpart', 'accessory', 'module', 'system') THEN 'component' ELSE 'support' END"
NQ = "nq AS (SELECT item_id AS query_id, text AS query FROM benchmark)"


def node_queries(t: Tables):
    return t.questions()


@query(
    "seed_nodes",
    f"""WITH {GRAPH}, {NQ}, tk AS (SELECT query_id, unnest(regexp_extract_all(lower(query), '[0-9a-z]+')) AS w FROM nq),
s AS (SELECT q.query_id, n.id, (SELECT coalesce(sum(CASE WHEN contains(lower(n.label || ' ' || n.type), w) THEN CASE WHEN length(w) = 1 THEN 2 ELSE 4 END ELSE 0 END), 0) FROM tk WHERE tk.query_id = q.query_id)
  + CASE WHEN contains(lower(n.label || ' ' || n.type), lower(query)) THEN 6 ELSE 0 END + CASE WHEN {FAM.format('n.type')} = 'regulation' THEN 2 ELSE 0 END AS score FROM nq q, nodes n)
SELECT query_id, id, score::DOUBLE AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score > 0) WHERE rank <= 4""",
)
def seed_nodes(t):
    return gq.seed_nodes(node_queries(t), t.graph()[0]).withColumn("rank", F.col("rank").cast("long"))


SN = rf"""sn AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT q.query_id, n.id, CASE WHEN contains(lower(n.label), lower(query)) THEN 10 ELSE 0 END + 3 * len(list_filter(list_distinct(regexp_split_to_array(lower(query), '\s+')), lambda w: length(w) >= 2 AND contains(lower(n.label), w)))
  + CASE WHEN lower(n.type) IN ('section', 'requirement', 'component') THEN 1 ELSE 0 END AS score FROM nq q, nodes n) WHERE score > 0)"""


@query("score_nodes", f"WITH {GRAPH}, {NQ}, {SN} SELECT query_id, id, score::DOUBLE AS score, rank FROM sn WHERE rank <= 10")
def score_nodes(t):
    return gq.score_nodes(node_queries(t), t.graph()[0]).withColumn("rank", F.col("rank").cast("long"))


BOTH = "both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"
HOP = """h0 AS (SELECT seed, seed AS id FROM seeds), h1 AS (SELECT DISTINCT seed, dst AS id FROM h0 JOIN both_ways ON src = id),
h2 AS (SELECT DISTINCT seed, dst AS id FROM h1 JOIN both_ways ON src = id), h3 AS (SELECT DISTINCT seed, dst AS id FROM h2 JOIN both_ways ON src = id),
hop AS (SELECT seed, id, min(d) AS distance FROM (SELECT *, 0 AS d FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2 UNION ALL SELECT *, 3 FROM h3) GROUP BY seed, id)"""


def seeds(t: Tables):
    return t("region").select(F.concat(F.lit("page:"), "r_regionkey").alias("seed"))


@query(
    "khop",
    f"WITH {GRAPH}, {BOTH}, seeds AS (SELECT 'page:' || r_regionkey AS seed FROM region), {HOP} SELECT seed, id, distance::BIGINT AS distance FROM hop WHERE distance > 0",
)
def khop(t):
    return gq.khop(seeds(t), t.graph()[1], 3).withColumn("distance", F.col("distance").cast("long"))


@query("expand_subgraph")
def expand_subgraph(t):
    nodes, edges = t.graph()
    start = t("region").select(F.col("r_regionkey").cast("long").alias("query_id"), F.concat(F.lit("page:"), F.col("r_regionkey") * 3).alias("id"), F.lit(1).alias("position"))
    return gq.expand_subgraph(start, nodes, edges).select("query_id", "id", F.col("level").cast("long"), F.col("rank").cast("long"))


IND = f"""{GRAPH}, {BOTH}, seeds AS (SELECT 'page:' || r_regionkey AS seed FROM region), {HOP}, sets AS (SELECT seed AS set_id, id FROM hop WHERE distance <= 2),
ind AS (SELECT DISTINCT a.set_id, src, dst, type FROM edges JOIN sets a ON a.id = src JOIN sets b ON b.id = dst AND b.set_id = a.set_id)"""


def node_sets(t: Tables):
    s = seeds(t)
    return gq.khop(s, t.graph()[1], 2).select(F.col("seed").alias("set_id"), "id").union(s.select("seed", "seed"))


@query("induced_edges", f"WITH {IND} SELECT * FROM ind")
def induced_edges(t):
    return gq.induced_edges(node_sets(t), t.graph()[1])


DEG = "deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id)"


@query(
    "overview_nodes",
    f"""WITH {GRAPH}, {DEG} SELECT id, CASE {FAM.format('type')} WHEN 'regulation' THEN 0 WHEN 'component' THEN 1 ELSE 2 END::BIGINT AS family, coalesce(degree, 0) AS degree
FROM nodes LEFT JOIN deg USING (id) ORDER BY family, degree DESC, label, id LIMIT 5""",
)
def overview_nodes(t):
    return gq.overview_nodes(*t.graph()).select("id", F.col("family").cast("long"), "degree")


@query(
    "subgraph_summary",
    f"""WITH {IND}, f AS (SELECT set_id, {FAM.format('type')} AS family FROM sets JOIN nodes USING (id)), e AS (SELECT set_id, count(*) AS edges FROM ind GROUP BY set_id)
SELECT set_id, count(*) FILTER (family = 'regulation') AS regulation, count(*) FILTER (family = 'component') AS component, count(*) FILTER (family = 'support') AS support, coalesce(max(edges), 0) AS edges
FROM f LEFT JOIN e USING (set_id) GROUP BY set_id""",
)
def subgraph_summary(t):
    return gq.subgraph_summary(node_sets(t), *t.graph())


NET = f"""{GRAPH}, {BOTH}, {NQ}, hit AS (SELECT DISTINCT query_id, id FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[0-9a-z]+')) AS w FROM nq) JOIN nodes ON contains(lower(label), w)),
net AS (SELECT query_id, id FROM hit UNION SELECT query_id, dst FROM hit JOIN both_ways ON src = id)"""


@query("filter_network_nodes", f"WITH {NET} SELECT query_id, id FROM net")
def filter_network_nodes(t):
    return gq.filter_network(node_queries(t), *t.graph())[0]


@query("filter_network_edges", f"WITH {NET} SELECT a.query_id, src, dst, type FROM edges JOIN net a ON a.id = src JOIN net b ON b.id = dst AND b.query_id = a.query_id")
def filter_network_edges(t):
    return gq.filter_network(node_queries(t), *t.graph())[1].select("query_id", "src", "dst", "type")


@query(
    "resolve_node",
    f"""WITH {GRAPH}, names AS (SELECT DISTINCT CASE k % 4 WHEN 0 THEN 'page:' || k WHEN 1 THEN 'doc:page:' || k WHEN 2 THEN upper('Word:' || lower(p_type)) ELSE 'ge:' || k END AS name FROM (SELECT p_partkey AS k, p_type FROM part)),
c AS (SELECT name, id, CASE WHEN name = id THEN 1 WHEN replace(replace(name, ':', '_'), '-', '_') = id THEN 2 WHEN starts_with(name, 'doc:') AND substr(name, 5) = id THEN 3
  WHEN contains(lower(id), lower(name)) OR contains(lower(name), lower(id)) THEN 4 END AS stage FROM names, nodes)
SELECT name, stage::BIGINT AS stage, id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY stage, id) AS rn FROM c WHERE stage IS NOT NULL) WHERE rn = 1""",
)
def resolve_node(t):
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("page:"), k)).when(k % 4 == 1, F.concat(F.lit("doc:page:"), k)).when(
        k % 4 == 2, F.upper(F.concat(F.lit("Word:"), F.lower("p_type")))).otherwise(F.concat(F.lit("ge:"), k))
    return gq.resolve_node(t("part").select(name.alias("name")).distinct(), t.graph()[0]).withColumn("stage", F.col("stage").cast("long"))


@query(
    "paths",
    f"""WITH RECURSIVE {GRAPH}, {BOTH}, pr AS (SELECT 'page:' || r_regionkey AS source, 'word:the' AS target FROM region),
p AS (SELECT source, target, source AS last, [source] AS path FROM pr UNION ALL
  SELECT source, target, dst, list_append(path, dst) FROM p JOIN both_ways ON src = last WHERE last <> target AND len(path) < 4 AND NOT list_contains(path, dst)),
o AS (SELECT source, target, len(path) AS length, array_to_string(path, '>') AS path FROM p WHERE last = target)
SELECT source, target, length, path, rank FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY length, path) AS rank FROM o) WHERE rank <= 10""",
)
def paths(t):
    pairs = t("region").select(F.concat(F.lit("page:"), "r_regionkey").alias("source"), F.lit("word:the").alias("target"))
    out = gq.paths(pairs, t.graph()[1], 4, limit=10)
    return out.withColumns({"length": F.col("length").cast("long"), "rank": F.col("rank").cast("long")})


@query(
    "semantic_relations",
    f"""WITH {GRAPH}, {NQ}, {SN}, e AS (SELECT query_id, src, dst, type, min(rank) AS node_rank FROM edges JOIN sn ON (sn.id = src OR sn.id = dst) WHERE rank <= 5 GROUP BY ALL)
SELECT query_id, src, dst, type, node_rank, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY node_rank, src, dst, type) AS rank FROM e) WHERE rank <= 20""",
)
def semantic_relations(t):
    out = gq.semantic_relations(node_queries(t), *t.graph(), limit=20)
    return out.withColumns({"node_rank": F.col("node_rank").cast("long"), "rank": F.col("rank").cast("long")})


@query(
    "degree_stats",
    f"WITH {GRAPH} SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, count(*) AS degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY id",
)
def degree_stats(t):
    return gq.degree_stats(t.graph()[1])


@query("hubs", f"WITH {GRAPH}, {DEG} SELECT id, degree FROM deg ORDER BY degree DESC, id LIMIT 20")
def hubs(t):
    return gq.hubs(t.graph()[1]).select("id", "degree")


@query("type_counts", f"WITH {GRAPH} SELECT type, count(*) AS n, 'node' AS kind FROM nodes GROUP BY type UNION ALL SELECT type, count(*), 'edge' FROM edges GROUP BY type")
def type_counts(t):
    return gq.type_counts(*t.graph())


@query("clusters", f"WITH {SECTIONS}, z AS (SELECT number, count(*) AS members FROM sections GROUP BY number HAVING count(*) >= 2) SELECT number, node_id AS id, members FROM sections JOIN z USING (number)")
def clusters(t):
    return gq.clusters(t.sections().select("number", F.col("node_id").alias("id")), "number", 2)


@query(
    "insights",
    f"""WITH {GRAPH}, e AS (SELECT src, dst, CASE WHEN length(dst) % 2 = 0 THEN 'applies_to' ELSE 'references' END AS type FROM edges),
a AS (SELECT dst AS key, count(*) AS value FROM e WHERE type = 'applies_to' GROUP BY dst ORDER BY value DESC, key LIMIT 5), b AS (SELECT src AS key, count(*) AS value FROM e WHERE contains(src, ':') GROUP BY src ORDER BY value DESC, key LIMIT 5)
SELECT 'requirements' AS metric, '' AS key, count(*) AS value FROM nodes WHERE type = 'Section' UNION ALL
SELECT 'cross_references', '', count(*) FROM e WHERE type = 'references' AND string_split(src, ':')[1] <> string_split(dst, ':')[1]
UNION ALL SELECT 'component', key, value FROM a UNION ALL SELECT 'clause', key, value FROM b""",
)
def insights(t):
    nodes, edges = t.graph()
    e = edges.withColumn("type", F.when(F.length("dst") % 2 == 0, "applies_to").otherwise("references"))
    return gq.insights(nodes, e, "Section", "applies_to", "references")


@query(
    "isolated_count",
    f"WITH {GRAPH}, e AS (SELECT * FROM edges WHERE contains(dst, 'th')) SELECT count(*) AS isolated FROM nodes WHERE id NOT IN (SELECT src FROM e UNION SELECT dst FROM e)",
)
def isolated_count(t):
    nodes, edges = t.graph()
    return gq.isolated_count(nodes, edges.filter("contains(dst, 'th')"))
