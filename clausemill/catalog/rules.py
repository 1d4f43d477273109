"""Classification and rule-tagging queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.catalog.base import GRAPH, SECTIONS, Tables, query, tok
from clausemill.operators import graph_build as gb
from clausemill.operators import rules as ru

# Rule words that occur in the given texts.
PATTERNS = {
    "regulatory": ["the", "die", "requ", "shall"], "method": ["how", "ing", "test", "que la"], "comparison": ["vs", "and", "und", "als"],
    "definition": ["what is", "tion", "est"], "numerical": ["value", "un", "1"], "cross_reference": ["equivalent to", "en la", "with"],
}


def user_turns(t: Tables):
    return t("conversations").filter("role = 'user'").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))


PAT_SQL = ", ".join(
    f"({o}, '{c}', '{w}', {i})" for o, (c, words) in enumerate(PATTERNS.items()) for i, w in enumerate(words)
)
INTENT = f"""uq AS (SELECT conv_id * 100 + turn AS query_id, text AS query, lower(text) AS low FROM conversations WHERE role = 'user'),
pat AS (SELECT * FROM (VALUES {PAT_SQL}) v(ord, intent, w, i)),
raw AS (SELECT query_id, ord, intent, sum(CASE WHEN contains(low, w) THEN 3.0 ELSE 0 END
   + CASE WHEN list_has_any({tok('w')}, {tok('low')}) THEN 0.5 ELSE 0 END + CASE WHEN strpos(low, w) BETWEEN 1 AND 5 THEN 2.0 ELSE 0 END)::DOUBLE AS s
   FROM uq, pat GROUP BY ALL),
sh AS (SELECT query_id, ord, intent, CASE WHEN sum(s) OVER (PARTITION BY query_id) > 0 THEN s / sum(s) OVER (PARTITION BY query_id) ELSE 0 END AS p FROM raw),
rm AS (SELECT query_id, max(p) FILTER (intent = 'regulatory') AS r, max(p) FILTER (intent = 'method') AS m FROM sh GROUP BY query_id),
intents AS (SELECT query_id, ord, intent, CASE WHEN r > 0.3 AND m > 0.2 AND intent IN ('regulatory', 'method') THEN (r + m) / 2 * 0.6 ELSE p END AS score FROM sh JOIN rm USING (query_id)),
prim AS (SELECT query_id, intent, score AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS rn FROM intents) WHERE rn = 1)"""


@query("intent_scores", f"WITH {INTENT} SELECT query_id, intent, round(score, 6) AS score FROM intents")
def intent_scores(t):
    return ru.intent_scores(user_turns(t), PATTERNS).select("query_id", "intent", F.round("score", 6).alias("score"))


@query("primary_intent", f"WITH {INTENT} SELECT query_id, intent, round(confidence, 6) AS confidence FROM prim")
def primary_intent(t):
    return ru.primary_intent(user_turns(t), PATTERNS).select("query_id", "intent", F.round("confidence", 6).alias("confidence"))


@query(
    "query_type",
    """SELECT conv_id, turn, CASE WHEN regexp_matches(text, 'requ|stand') THEN 'regulatory' WHEN regexp_matches(text, 'ing|ment') THEN 'method'
WHEN regexp_matches(text, 'und|and') THEN 'comparison' ELSE 'general' END AS query_type FROM conversations WHERE role = 'user'""",
)
def query_type(t):
    rules = [("requ|stand", "regulatory"), ("ing|ment", "method"), ("und|and", "comparison")]
    return t("conversations").filter("role = 'user'").select("conv_id", "turn", ru.query_type(F.col("text"), rules).alias("query_type"))


@query(
    "retrieval_plan",
    f"""WITH {INTENT}, req AS (SELECT p.*, CASE WHEN query_id % 3 = 0 THEN query_id % 17 END AS rk,
  CASE WHEN query_id % 5 = 0 THEN 'graph_first' WHEN query_id % 7 = 0 THEN 'detailed' END AS mode FROM prim p),
k AS (SELECT *, CASE WHEN rk IS NOT NULL THEN greatest(1, least(rk, 10)) WHEN intent IN ('numerical', 'method') THEN 5 WHEN intent = 'comparison' THEN 4 ELSE 3 END AS k FROM req)
SELECT query_id, CASE WHEN mode = 'graph_first' THEN mode WHEN confidence < 0.5 OR intent IN ('numerical', 'method') THEN 'expanded' WHEN intent = 'comparison' THEN 'multi_source'
  WHEN intent = 'cross_reference' THEN 'graph_first' ELSE 'simple' END AS strategy,
  (CASE WHEN mode = 'detailed' THEN greatest(k, 5) ELSE k END)::BIGINT AS top_k, (intent IN ('numerical', 'method') OR confidence < 0.5) AS use_expansion FROM k""",
)
def retrieval_plan(t):
    q = ru.primary_intent(user_turns(t), PATTERNS)
    q = q.withColumn("requested_k", F.when(F.col("query_id") % 3 == 0, F.col("query_id") % 17)).withColumn(
        "requested_mode", F.when(F.col("query_id") % 5 == 0, "graph").when(F.col("query_id") % 7 == 0, "full"))
    return ru.retrieval_plan(q).select("query_id", "strategy", "top_k", "use_expansion")


SUBS = r"""subs AS (SELECT query_id, (i - 1)::BIGINT AS sub, c[i] AS text FROM (
  SELECT query_id, (CASE WHEN len(cut) > 0 THEN cut WHEN len(ph) > 0 THEN ph[greatest(len(ph) - 1, 1):] ELSE [query] END)[1:4] AS c FROM (
    SELECT query_id, query, list_filter(list_transform(CASE WHEN contains(low, ' and ') THEN string_split(low, ' and ') WHEN contains(low, ' und ') THEN string_split(low, ' und ') ELSE [] END, lambda p: trim(p)), lambda p: length(p) > 2) AS cut,
      list_filter(r, lambda x, i: list_position(r, x) = i) AS ph FROM (
        SELECT conv_id * 100 + turn AS query_id, text AS query, lower(text) AS low, regexp_extract_all(lower(text), '[a-z][a-z0-9_\-]{2,}') AS r FROM conversations WHERE role = 'user'))), range(1, 5) g(i)
  WHERE i <= len(c))"""


@query("subqueries", f"WITH {SUBS} SELECT * FROM subs")
def subqueries(t):
    return ru.subqueries(user_turns(t), [" and ", " und "]).withColumn("sub", F.col("sub").cast("long"))


DOMAINS = {"fire": ["feu", "flam", "thre"], "structure": ["ment", "load"], "safety": ["heit", "sich"], "system": ["ción", "sis", "tion"]}


def any_sql(col, words):
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


def count_sql(col, words):
    return "(" + " + ".join(f"contains({col}, '{w}')::INT" for w in words) + ")"


FIRST_SQL = "CASE " + " ".join(f"WHEN {any_sql('lower(title)', w)} OR {any_sql('lower(text)', w)} THEN '{d}'" for d, w in DOMAINS.items()) + " WHEN regexp_matches(title, '[0-9]') THEN 'numbered' ELSE 'none' END"
SCORES = [(d, f"({count_sql('lower(title)', w)} * 10 + {count_sql('lower(text)', w)} * 5)") for d, w in DOMAINS.items()]
_ALL = ", ".join(s for _, s in SCORES)
SCORED_SQL = f"CASE WHEN greatest({_ALL}) = 0 THEN 'none' " + " ".join(f"WHEN {s} = greatest({_ALL}) THEN '{d}'" for d, s in SCORES) + " END"
DOM = f"{SECTIONS}, dom AS (SELECT node_id, doc, number, title, text, ordinal, {SCORED_SQL} AS domain FROM sections)"


def domained(t: Tables):
    d = ru.classify_domain_scored(F.col("title"), F.col("text"), DOMAINS)
    return t.sections().withColumn("domain", F.coalesce(d, F.lit("none")))


@query("classify_domain_first", f"WITH {SECTIONS} SELECT node_id, {FIRST_SQL} AS domain FROM sections")
def classify_domain_first(t):
    d = ru.classify_domain_first(F.col("title"), F.col("text"), DOMAINS, [("[0-9]", "numbered")])
    return t.sections().select("node_id", F.coalesce(d, F.lit("none")).alias("domain"))


@query("classify_domain_scored", f"WITH {DOM} SELECT node_id, domain FROM dom")
def classify_domain_scored(t):
    return domained(t).select("node_id", "domain")


REQ = ["that", "pour", "nicht", "para", "shall"]
MAT = ["metal", "alloy", "stein", "tion"]


@query(
    "content_flags",
    rf"""WITH k AS (SELECT *, list_filter(list_transform(string_split(text, '.'), lambda s: regexp_replace(s, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')),
  lambda s: length(s) > 10 AND {any_sql('s', REQ)}) AS ks FROM documents)
SELECT doc_id, {any_sql('text', REQ)} AS has_requirements, regexp_matches(text, '[0-9]+%') AS has_percent, regexp_matches(text, '[0-9]+°?[CFc]') AS has_temperature,
  regexp_matches(text, '[0-9]+\s*(秒|分钟|小时)') AS has_time, {any_sql('text', MAT)} AS has_material,
  array_to_string(list_transform(ks[1:3], lambda s: substr(s, 1, 100)), '|') AS key_sentences FROM k""",
)
def content_flags(t):
    flags = ru.content_flags(F.col("text"), REQ, MAT, "\\.")
    flags["key_sentences"] = F.array_join(flags["key_sentences"], "|")
    return t.docs().select("doc_id", *[c.alias(n) for n, c in flags.items()])


NOTES = [("fire", "est", "seal"), ("structure", "les", "fatigue"), ("structure", None, "margin"), ("safety", None, "fmea"), ("system", "tha", "redundancy")]
NOTES_SQL = ", ".join(f"('{d}', {repr(w) if w else 'NULL'}, '{n}', {i})" for i, (d, w, n) in enumerate(NOTES))


@query(
    "implications",
    f"WITH {DOM} SELECT node_id, domain, o::BIGINT AS ordinal, n AS note FROM dom JOIN (VALUES {NOTES_SQL}) r(d, w, n, o) ON d = domain AND (w IS NULL OR contains(lower(text), w))",
)
def implications(t):
    return ru.implications(domained(t), NOTES).withColumn("ordinal", F.col("ordinal").cast("long"))


TEMPLATES = [("fire", "barrier", "burn test", "check seals;check doors"), ("structure", "strength", "load test", "check load"), ("safety", "analysis", "fault tree", "list failures;rate failures;close failures")]
DEFAULTS = {"requirements": "see text", "methods": "review", "checklist": "read clause"}
INTERP = f"""{DOM}, interp AS (SELECT node_id, doc, domain, coalesce(r, 'see text') AS requirements, coalesce(m, 'review') AS methods, coalesce(c, 'read clause') AS checklist
  FROM dom LEFT JOIN (VALUES {', '.join(str(x) for x in TEMPLATES)}) v(d, r, m, c) ON d = domain)"""


def interpreted(t: Tables):
    tpl = t.rows("domain string, requirements string, methods string, checklist string", TEMPLATES)
    return ru.interpretations(domained(t).select("node_id", "doc", "domain"), tpl, DEFAULTS)


@query("interpretations", f"WITH {INTERP} SELECT node_id, domain, requirements, methods FROM interp")
def interpretations(t):
    return interpreted(t).select("node_id", "domain", "requirements", "methods")


@query(
    "checklists",
    f"""WITH {INTERP} SELECT node_id, domain, (i - 1)::BIGINT AS step, p[i] AS task, CASE WHEN domain IN ('fire', 'safety') THEN 'HIGH' ELSE 'MEDIUM' END AS priority
FROM (SELECT node_id, domain, string_split(checklist, ';') AS p FROM interp), range(1, 10) r(i) WHERE i <= len(p)""",
)
def checklists(t):
    return ru.checklists(interpreted(t), ["fire", "safety"]).withColumn("step", F.col("step").cast("long"))


@query("verification_plans", f"WITH {INTERP} SELECT node_id, domain, array_to_string(list_transform(string_split(methods, ';'), lambda m: trim(m)), '|') AS plan FROM interp WHERE trim(methods) <> ''")
def verification_plans(t):
    return ru.verification_plans(interpreted(t)).withColumn("plan", F.array_join("plan", "|"))


@query(
    "design_tasks",
    f"""WITH {INTERP} SELECT node_id, domain, (i - 1)::BIGINT AS step, trim(p[i]) AS task, methods AS verification, CASE WHEN domain IN ('fire', 'safety') THEN 'HIGH' ELSE 'MEDIUM' END AS priority
FROM (SELECT node_id, domain, methods, string_split(requirements, ';') AS p FROM interp WHERE trim(requirements) <> ''), range(1, 10) r(i) WHERE i <= len(p)""",
)
def design_tasks(t):
    return ru.design_tasks(interpreted(t), ["fire", "safety"]).withColumn("step", F.col("step").cast("long"))


@query(
    "design_parameters",
    rf"""WITH {DOM}, m AS (SELECT node_id, domain, list_transform(regexp_extract_all(sections.text, '[0-9]+ [a-z]+'), lambda x: trim(x)) AS r FROM dom JOIN sections USING (node_id) WHERE domain IS NOT NULL),
d AS (SELECT node_id, domain, list_filter(r, lambda x, i: list_position(r, x) = i) AS p FROM m)
SELECT node_id, domain, (i - 1)::BIGINT AS step, p[i] AS parameter FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM d)""",
)
def design_parameters(t):
    rows = domained(t).select("node_id", "domain").join(t.sections().select("node_id", "text"), "node_id")
    return ru.design_parameters(rows, "[0-9]+ [a-z]+").withColumn("step", F.col("step").cast("long"))


@query(
    "domain_pairs",
    f"""WITH {DOM}, d AS (SELECT DISTINCT domain, node_id FROM dom WHERE domain IS NOT NULL),
p AS (SELECT a.node_id AS src, b.node_id AS dst, domain FROM d a JOIN d b USING (domain) WHERE a.node_id < b.node_id ORDER BY domain, src, dst LIMIT 100)
SELECT src, dst, domain FROM p UNION ALL SELECT dst, src, domain FROM p""",
)
def domain_pairs(t):
    return gb.domain_pairs(domained(t).select("node_id", "domain"), symmetric=True)


METHODS = {"test": ["test", "tion"], "analysis": ["anal", "heit"], "inspection": ["ment"]}
_M = " UNION ALL ".join(
    f"SELECT doc_id, '{m}' AS method, '{w}' AS keyword, list_filter(string_split(text, '.'), lambda s: contains(lower(s), '{w}'))[1] AS s FROM documents"
    for m, ws in METHODS.items() for w in ws
)


@query(
    "compliance_methods",
    rf"SELECT doc_id AS node_id, method, keyword, substr(regexp_replace(s, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g'), 1, 200) AS context FROM ({_M}) WHERE s IS NOT NULL",
)
def compliance_methods(t):
    return ru.compliance_methods(t.docs().withColumnRenamed("doc_id", "node_id"), METHODS, r"\.")


GROUPS = {"test": ["test", "ting"], "design": ["ment", "des"], "analysis": ["zz", "ana"]}


@query(
    "compliance_context",
    "SELECT doc_id, " + ", ".join(
        f"{any_sql('lower(text)', w)} AS has_{g}, coalesce(list_filter({w}, lambda x: contains(lower(text), x))[1], '') AS first_{g}" for g, w in GROUPS.items()
    ) + " FROM documents",
)
def compliance_context(t):
    return t.docs().select("doc_id", *[c.alias(n) for n, c in ru.compliance_context(F.col("text"), GROUPS).items()])


@query(
    "enrich_metadata",
    rf"""WITH {SECTIONS}, u AS (SELECT 'src' || (s_suppkey % 20) AS doc, min('https://' || s_name) AS url FROM supplier WHERE s_acctbal > 0 GROUP BY 1),
r AS (SELECT node_id, doc, number || ' ' || title AS title, text FROM sections),
e AS (SELECT node_id, doc, CASE WHEN contains(title, 'General') THEN 'A' WHEN contains(title, 'Performance') THEN '性能' WHEN contains(title, 'Design') THEN '设计' ELSE '' END AS chapter,
  coalesce(nullif(regexp_extract(title, '([A-Z]\.[0-9]+|[0-9]+\.[0-9]+[a-z]?)', 1), ''), '') AS section,
  CASE WHEN doc LIKE 'src1%' THEN 'CAAC' WHEN doc LIKE 'src2%' THEN 'FAA' ELSE 'UNKNOWN' END AS agency, 'doc_' || doc AS document_id, length(text) AS content_length,
  {any_sql('lower(text)', ru.ENRICH_REQUIREMENTS)} AS has_requirements, text FROM r)
SELECT e.* EXCLUDE (text), e.doc || ' §' || section AS citation, coalesce(v, 'unknown') AS document_version, coalesce(k, 'unknown') AS document_type,
  CASE WHEN chapter <> '' AND section <> '' THEN chapter || ' > ' || section ELSE section END AS chapter_section, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview, CASE WHEN url IS NULL THEN '' WHEN section <> '' THEN url || '#section-' || replace(section, '.', '_') ELSE url END AS source_link
FROM e LEFT JOIN u USING (doc) LEFT JOIN (SELECT 'src' || n_nationkey AS doc, 'R' || n_regionkey AS v, n_name AS k FROM nation WHERE n_nationkey < 12) f USING (doc)""",
)
def enrich_metadata(t):
    urls = t("supplier").filter("s_acctbal > 0").groupBy(F.concat(F.lit("src"), F.col("s_suppkey") % 20).alias("doc")).agg(
        F.min(F.concat(F.lit("https://"), "s_name")).alias("url"))
    facts = t("nation").filter("n_nationkey < 12").select(
        F.concat(F.lit("src"), "n_nationkey").alias("doc"), F.concat(F.lit("R"), "n_regionkey").alias("version"), F.col("n_name").alias("type"))
    r = t.sections().select("node_id", "doc", F.concat_ws(" ", "number", "title").alias("title"), "text")
    return ru.enrich_metadata(r, urls, [("src1", "CAAC"), ("src2", "FAA")], facts).drop("title", "text")


@query(
    "authority_score",
    """SELECT doc_id, greatest(0.0, CASE WHEN contains(upper(source), '1') THEN 10.0 ELSE 0 END, CASE WHEN contains(upper(source), 'SRC') THEN 5.5 ELSE 0 END, CASE WHEN contains(upper(lang), 'EN') THEN 8.0 ELSE 0 END)::DOUBLE
  + CASE WHEN regexp_matches(string_split(text, chr(10))[1], '[0-9]') THEN 1.0 ELSE 0 END::DOUBLE AS authority FROM documents""",
)
def authority_score(t):
    w = {"1": 10.0, "SRC": 5.5, "EN": 8.0}
    return t("documents").select("doc_id", ru.authority_score(F.col("source"), F.col("lang"), F.split("text", "\n")[0], w).alias("authority"))


@query(
    "domain_of_query",
    "SELECT conv_id, turn, CASE " + " ".join(f"WHEN {any_sql('lower(text)', w)} THEN '{d}'" for d, w in DOMAINS.items()) + " ELSE 'general' END AS domain FROM conversations WHERE role = 'user'",
)
def domain_of_query(t):
    return t("conversations").filter("role = 'user'").select("conv_id", "turn", ru.domain_of_query(F.col("text"), DOMAINS).alias("domain"))


AG = "CASE WHEN upper({0}) LIKE '%7%' THEN 'CAAC' WHEN upper({0}) LIKE '%TION%' THEN 'FAA' WHEN upper({0}) LIKE '%HEIT%' THEN 'EASA' END"


@query(
    "agency_of_node",
    f"""WITH {GRAPH}, b AS (SELECT src AS id, dst AS n FROM edges UNION ALL SELECT dst, src FROM edges),
near AS (SELECT id, min({AG.format('n')}) AS near FROM b GROUP BY id)
SELECT id, coalesce({AG.format('id')}, {AG.format('label')}, near, 'OTHER') AS agency FROM nodes LEFT JOIN near USING (id)""",
)
def agency_of_node(t):
    nodes, edges = t.graph()
    return ru.agency_of_node(nodes, edges, [("7", "CAAC"), ("TION", "FAA"), ("HEIT", "EASA")])


@query(
    "node_family",
    f"WITH {GRAPH} SELECT id, CASE WHEN type = 'Section' THEN 'regulation' WHEN type = 'RotorPart' THEN 'component' ELSE 'support' END AS family FROM nodes",
)
def node_family(t):
    return t.graph()[0].select("id", ru.node_family(F.col("type")).alias("family"))


@query(
    "screen_injection",
    rf"""WITH c AS (SELECT doc_id, string_split(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), chr(10)) AS l FROM documents)
SELECT doc_id, len(list_filter(l, lambda x: regexp_matches(x, '(?i)(token\s*=|api|the\s+the\s)'))) > 0 AS suspicious,
  md5(array_to_string(list_transform(l, lambda x: CASE WHEN regexp_matches(x, '(?i)(token\s*=|api|the\s+the\s)') THEN '{ru.INJECTION_NOTE}' || substr(x, 1, 80) || '...' ELSE x END), chr(10))) AS digest FROM c""",
)
def screen_injection(t):
    out = ru.screen_injection(t.docs(), patterns=[r"token\s*=", "api", r"the\s+the\s"])
    return out.select("doc_id", "suspicious", F.md5("safe_text").alias("digest"))
