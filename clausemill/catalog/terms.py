"""Token, dictionary and term-mining queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.catalog.base import SECTIONS, Tables, query, tok
from clausemill.catalog.search import DICT, MIXED, TWO_HOP, phr, synonyms
from clausemill.functions import text as tx
from clausemill.functions.scale import stored
from clausemill.operators import terms as tm

STOP = ["the", "and", "of", "to", "in", "de", "la", "die", "der", "que"]
STOP_SQL = "(" + ", ".join(f"'{w}'" for w in STOP) + ")"
WORD5 = r"[a-z]{5,}"

# order-keeping positions for lists in SQL
UNIQ = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


@query("tokenize", f"SELECT doc_id, (i - 1)::BIGINT AS pos, t[i] AS token FROM (SELECT doc_id, {tok('text')} AS t FROM documents), range(1, len(t) + 1) r(i)")
def tokenize(t):
    return tm.tokenize(t.docs()).withColumn("pos", F.col("pos").cast("long"))


@query(
    "tokenize_search",
    f"""WITH k AS (SELECT doc_id, pos, token, row_number() OVER (PARTITION BY doc_id, token ORDER BY pos) AS rn FROM (
  SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, {tok('text')} AS t FROM documents)))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos, token FROM k WHERE rn = 1""",
)
def tokenize_search(t):
    return tm.tokenize_search(t.docs()).withColumn("pos", F.col("pos").cast("long"))


@query(
    "phrase_candidates",
    r"""WITH k AS (SELECT conv_id, turn, pos, p, row_number() OVER (PARTITION BY conv_id, turn, p ORDER BY pos) AS rn FROM (
  SELECT conv_id, turn, unnest(t) AS p, generate_subscripts(t, 1) AS pos
  FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z][a-z0-9_\-]{2,}') AS t FROM conversations)))
SELECT conv_id * 100 + turn AS id, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) - 1 AS pos, p AS phrase FROM k WHERE rn = 1""",
)
def phrase_candidates(t):
    c = t("conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    return tm.phrase_candidates(c, id="id").withColumn("pos", F.col("pos").cast("long"))


@query(
    "tokenize_enhanced",
    rf"""SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{{L}}+|\p{{N}}+')) AS token FROM documents)
WHERE length(token) >= 2 AND token NOT IN {STOP_SQL}""",
)
def tokenize_enhanced(t):
    return tm.tokenize_enhanced(t.docs(), STOP)


@query(
    "tokenize_ngram",
    r"SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[\s,，。？！]+')) AS token FROM documents) WHERE length(token) >= 2",
)
def tokenize_ngram(t):
    return tm.tokenize_ngram(t.docs())


@query(
    "query_keywords",
    f"""WITH k AS (SELECT id, list_filter(w, lambda x: length(x) >= 2 AND x NOT IN {STOP_SQL}) AS w FROM (
  SELECT conv_id * 100 + turn AS id, {tok('text')} AS w FROM conversations WHERE role = 'user')),
u AS (SELECT id, {UNIQ.format('w')}[1:6] AS u FROM k)
SELECT id, (i - 1)::BIGINT AS pos, u[i] AS keyword FROM u, range(1, len(u) + 1) r(i)""",
)
def query_keywords(t):
    c = t("conversations").filter("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    return tm.query_keywords(c, STOP, "id", "text").withColumn("pos", F.col("pos").cast("long"))


@query(
    "expand_synonyms",
    f"""WITH {DICT}, found AS (SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id, unnest({phr('text')}) AS term FROM benchmark)),
{TWO_HOP.format('hop', 'found')} SELECT query_id, term FROM hop""",
)
def expand_synonyms(t):
    return tm.expand_synonyms(t.questions(), synonyms(t))


@query("expand_mixed", f"WITH {MIXED} SELECT query_id, term FROM expansion")
def expand_mixed(t):
    return tm.expand_mixed(t.questions(), synonyms(t))


@query(
    "expand_by_containment",
    f"""WITH {DICT}, d AS (SELECT DISTINCT term, synonym FROM dict)
SELECT DISTINCT query_id, term FROM (
  SELECT item_id AS query_id, synonym AS term FROM benchmark, d WHERE contains(lower(text), d.term)
  UNION ALL SELECT item_id, d.term FROM benchmark, d WHERE contains(lower(text), d.synonym))""",
)
def expand_by_containment(t):
    return tm.expand_by_containment(t.questions().withColumn("query", F.lower("query")), synonyms(t))


@query(
    "normalise_terms",
    f"""WITH {DICT}, rev AS (SELECT synonym, arg_max(term, (ordinal, term)) AS std FROM dict GROUP BY synonym)
SELECT d.item_id, d.word, coalesce(rev.std, d.word) AS standard FROM (
  SELECT item_id, unnest(list_distinct({tok('text')})) AS word FROM benchmark) d LEFT JOIN rev ON rev.synonym = d.word""",
)
def normalise_terms(t):
    words = t("benchmark").select("item_id", F.explode(tx.search_tokens(F.col("text"))).alias("word"))
    return tm.normalise_terms(words, synonyms(t), "word")


CATEGORIES = {"motion": {"tion": ["ation", "ition"], "ing": ["ring"]}, "state": {"ment": ["heit"], "able": ["ible", "keit"]}, "rare": {"fer": ["zwq"]}}
CATEGORY_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS category, '{term}' AS term, [{', '.join(repr(w) for w in [term, *syn])}] AS words"
    for c, terms in CATEGORIES.items() for term, syn in terms.items()
)


@query(
    "tag_terms",
    f"""SELECT doc_id, category, term FROM documents, ({CATEGORY_SQL}) r
WHERE len(list_filter(words, lambda w: contains(text, w))) > 0""",
)
def tag_terms(t):
    return tm.tag_terms(t.docs(), "doc_id", "text", CATEGORIES)


@query(
    "related_terms",
    f"""WITH {DICT}, names AS (SELECT term AS name FROM dict UNION SELECT synonym FROM dict),
mine AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS term FROM part UNION
  SELECT DISTINCT unnest({tok('text')}) FROM benchmark),
m AS (SELECT term FROM mine WHERE length(term) > 0)
SELECT DISTINCT term, name FROM m, names WHERE term <> name AND (contains(term, name) OR contains(name, term))""",
)
def related_terms(t):
    return tm.related_terms(words_table(t), synonyms(t))


def words_table(t: Tables):
    a = t("part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("term"))
    b = t("benchmark").select(F.explode(tx.search_tokens(F.col("text"))).alias("term"))
    return a.union(b).filter("length(term) > 0").distinct()


@query(
    "term_statistics",
    f"""WITH {SECTIONS}, occ AS (SELECT doc, node_id, unnest(regexp_extract_all(lower(text), '{WORD5}')) AS term FROM sections),
d AS (SELECT term, doc, count(*) AS n, count(DISTINCT node_id) AS s FROM occ GROUP BY ALL)
SELECT term, sum(n)::BIGINT AS frequency, count(*) AS documents, sum(s)::BIGINT AS sections, max(n) AS max_per_document FROM d GROUP BY term""",
)
def term_statistics(t):
    return tm.term_statistics(t.sections().withColumn("text", F.lower("text")), WORD5)


KEYS = ["tion", "ment", "keit", "que", "THE"]
REQ = ["shall", "must", "that", "pour", "nicht", "para"]


def any_sql(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


@query(
    "section_statistics",
    f"""WITH {SECTIONS}, b AS (SELECT *, summary || array_to_string(content_parts, ' ') AS body FROM sections)
SELECT doc, number, node_id, (length(summary) + coalesce(list_sum(list_transform(content_parts, lambda p: length(p))), 0))::BIGINT AS content_length,
  {any_sql('body', REQ)} AS has_requirements,
  array_to_string(list_filter({KEYS}, lambda w: contains(title || body, w)), '|') AS keywords FROM b""",
)
def section_statistics(t):
    return tm.section_statistics(t.sections(), REQ, KEYS)


KNOWN = {"tion": ["ation"], "ment": ["ement", "zzzq"], "heit": []}
OCC = rf"""{SECTIONS}, f AS (SELECT doc, node_id, title || ' ' || summary || ' ' || array_to_string(content_parts, ' ') AS full FROM sections),
occ AS (
  SELECT DISTINCT doc, node_id, term FROM (
    SELECT doc, node_id, unnest(list_filter(['tion', 'ment', 'heit'], lambda w: contains("full", w))) AS term FROM f
    UNION ALL SELECT doc, node_id, 'ation' FROM f WHERE contains("full", 'tion') AND contains("full", 'ation')
    UNION ALL SELECT doc, node_id, 'ement' FROM f WHERE contains("full", 'ment') AND contains("full", 'ement')
    UNION ALL SELECT doc, node_id, a FROM (SELECT doc, node_id, unnest(regexp_extract_all("full", '[\p{{L}}\p{{N}}_]+')) AS a FROM f)
      WHERE a IN ('APU', 'OEI', 'ETOPS', 'VMC', 'VNE', 'TC', 'PC', 'FAR', 'CCAR', 'CS')
    UNION ALL SELECT doc, node_id, lower(a) FROM (SELECT doc, node_id, unnest(regexp_extract_all("full", '[\p{{L}}\p{{N}}_]+')) AS a FROM f)
      WHERE regexp_full_match(a, '[A-Z][A-Za-z]{{3,}}')
    UNION ALL SELECT doc, node_id, unnest(regexp_extract_all("full", '[A-Z][a-z]+-[A-Z][a-z]+')) FROM f
    UNION ALL SELECT doc, node_id, 'value:' || unnest(regexp_extract_all("full", '([0-9]+(?:\.[0-9]+)?)\s*%', 1)) || '%' FROM f)
  WHERE length(term) >= 2)"""
TYPE_SQL = r"""CASE WHEN term LIKE 'value:%' THEN 'value' WHEN upper(term) = term AND length(term) <= 6 THEN 'abbreviation'
  WHEN regexp_matches(term, '^[a-zA-Z\s]+$') THEN 'english' ELSE 'mixed' END"""
CAT_SQL = "CASE WHEN term LIKE 'value:%' THEN 'percentage' " + " ".join(
    f"WHEN {any_sql('term', words)} THEN '{c}'" for c, words in tm.TERM_CATEGORIES.items()
) + " ELSE 'other' END"
TERMS_SQL = f"""{OCC}, terms AS (SELECT term, count(*) AS frequency, count(DISTINCT doc) AS documents, {TYPE_SQL} AS type, {CAT_SQL} AS category
  FROM occ GROUP BY term HAVING count(*) >= 2)"""


def occurrences(t: Tables):
    return tm.term_occurrences(t.sections(), KNOWN)


@query("extract_terms", f"WITH {TERMS_SQL} SELECT * FROM terms")
def extract_terms(t):
    return tm.extract_terms(occurrences(t), 2)


@query(
    "cooccurrence",
    f"""WITH {TERMS_SQL}, o AS (SELECT DISTINCT node_id, term FROM occ WHERE term IN (SELECT term FROM terms)),
p AS (SELECT a.term AS t1, b.term AS t2, count(*) AS n FROM o a JOIN o b USING (node_id) WHERE a.term <> b.term GROUP BY ALL)
SELECT * FROM p WHERE n >= 2""",
)
def cooccurrence(t):
    o = stored(occurrences(t).select("doc", "node_id", "term"), "occurrences")
    return tm.cooccurrence(o, tm.extract_terms(o), 2)


@query(
    "synonym_edges",
    f"""WITH {DICT}, {TERMS_SQL.replace('sections AS', 'sections AS', 1)}
SELECT DISTINCT term, synonym FROM dict WHERE term IN (SELECT term FROM terms) AND synonym IN (SELECT term FROM terms)""",
)
def synonym_edges(t):
    return tm.synonym_edges(tm.extract_terms(occurrences(t)), synonyms(t))


# The given texts hold no bracketed abbreviations, so the patterns name upper-case words before a word and after one.
LONG_FIRST = r"([a-z]{4,}) ([A-Z]{2,6})[ .,]"
SHORT_FIRST = r" ([A-Z]{2,6}) ([a-z]{4,})"


@query(
    "detect_abbreviations",
    rf"""SELECT abbreviation, full_form, sum(one)::BIGINT AS n FROM (SELECT *, 1 AS one FROM (
  SELECT unnest(regexp_extract_all(text, '{LONG_FIRST}', 2)) AS abbreviation, unnest(regexp_extract_all(text, '{LONG_FIRST}', 1)) AS full_form FROM documents
  UNION ALL SELECT unnest(regexp_extract_all(text, '{SHORT_FIRST}', 1)), unnest(regexp_extract_all(text, '{SHORT_FIRST}', 2)) FROM documents)
  UNION ALL SELECT substr(n_name, 1, 3), lower(n_name), 0 FROM nation)
GROUP BY ALL""",
)
def detect_abbreviations(t):
    known = t("nation").select(F.substring("n_name", 1, 3).alias("abbreviation"), F.lower("n_name").alias("full_form"))
    return tm.detect_abbreviations(t.docs(), LONG_FIRST, SHORT_FIRST, known=known)


@query(
    "ontology_by_category",
    f"""WITH {DICT}, {TERMS_SQL}, e AS (SELECT DISTINCT term, synonym FROM dict WHERE term IN (SELECT term FROM terms) AND synonym IN (SELECT term FROM terms)),
r AS (SELECT term, count(*) AS relations FROM e GROUP BY term)
SELECT category, type, count(*) AS terms, sum(frequency)::BIGINT AS frequency, sum(coalesce(relations, 0))::BIGINT AS relations
FROM terms LEFT JOIN r USING (term) GROUP BY category, type""",
)
def ontology_by_category(t):
    return tm.ontology_by_category(tm.extract_terms(occurrences(t)), synonyms(t))


@query(
    "find_synonyms",
    f"""WITH {DICT}, n AS (SELECT term AS name FROM dict UNION SELECT synonym FROM dict),
m AS (SELECT DISTINCT term FROM (SELECT unnest({tok('text')}) AS term FROM benchmark UNION SELECT unnest(string_split(lower(p_name), ' ')) FROM part) WHERE length(term) > 0)
SELECT DISTINCT term, name FROM m, n WHERE term <> name AND (contains(term, name) OR contains(name, term))
UNION SELECT term, name FROM (SELECT term, synonym AS name FROM dict UNION SELECT synonym, term FROM dict) WHERE term IN (SELECT term FROM m)""",
)
def find_synonyms(t):
    return tm.find_synonyms(words_table(t), synonyms(t), synonyms(t))


@query(
    "discover_new_terms",
    f"""WITH f AS (SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{{3,6}}')) AS term FROM conversations WHERE role = 'user') GROUP BY term),
k AS (SELECT DISTINCT unnest({tok('text')}) AS w FROM benchmark),
parts AS (SELECT DISTINCT term FROM f, k WHERE contains(w, term))
SELECT term, n FROM f WHERE term NOT IN (SELECT term FROM parts) ORDER BY n DESC, term LIMIT 20""",
)
def discover_new_terms(t):
    known = t("benchmark").select(F.explode(tx.search_tokens(F.col("text"))).alias("term"))
    return tm.discover_new_terms(t("conversations").filter("role = 'user'"), known, "[a-z]{3,6}", "text")


@query("validate_terms", r"SELECT p_partkey, p_name AS term, regexp_full_match(p_name, '[A-Za-z0-9\-\s]{2,15}') AS valid FROM part")
def validate_terms(t):
    return tm.validate_terms(t("part").select("p_partkey", F.col("p_name").alias("term")))


@query(
    "merge_duplicate_terms",
    """WITH w AS (SELECT lower(trim(term)) AS term_key, term FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) AS term FROM documents))
SELECT term_key, count(*) AS rows, count(DISTINCT term) AS spellings, min(term) AS kept FROM w GROUP BY term_key HAVING count(*) > 1""",
)
def merge_duplicate_terms(t):
    return tm.merge_duplicate_terms(t("documents").select(F.explode(tx.matches(F.col("text"), "[A-Za-z]{4,}")).alias("term")))


@query(
    "query_signature",
    r"SELECT conv_id, turn, regexp_replace(lower(trim(text)), '[^\p{L}\p{N}_]', '', 'g') AS signature FROM conversations WHERE role = 'user'",
)
def query_signature(t):
    return t("conversations").filter("role = 'user'").select("conv_id", "turn", tm.query_signature(F.col("text")).alias("signature"))


@query(
    "term_type_category",
    f"SELECT term, {TYPE_SQL} AS type, {CAT_SQL} AS category FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9%]+')) AS term FROM documents)",
)
def term_type_category(t):
    words = t("documents").select(F.explode(tx.matches(F.col("text"), "[A-Za-z0-9%]+")).alias("term")).distinct()
    return words.select("term", tm.term_type(F.col("term")).alias("type"), tm.term_category(F.col("term")).alias("category"))
