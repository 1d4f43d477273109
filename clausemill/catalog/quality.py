"""Answer-quality and extractive-answer queries: assistant turns as answers, neighbouring turns as evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausemill.catalog.base import ANSWERS, EVIDENCE, SECTIONS, Tables, query
from clausemill.catalog.rules import any_sql, count_sql
from clausemill.functions import text as tx
from clausemill.operators import answers as an
from clausemill.operators import quality as ql

STRIP = r"regexp_replace({0}, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')"
TERMS3 = "list_distinct(regexp_extract_all(lower({0}), '[a-z]{{3,}}'))"


def support_sql(name: str, min_len: int) -> str:
    return rf"""{name}_st AS (SELECT answer_id, unnest(s) AS statement, generate_subscripts(s, 1) - 1 AS pos FROM (
  SELECT answer_id, list_filter(list_transform(regexp_split_to_array(answer, '[。！？.!?]'), lambda x: {STRIP.format('x')}), lambda x: length(x) >= {min_len}) AS s FROM answers)),
{name} AS (SELECT st.answer_id, pos, any_value(statement) AS statement,
  coalesce(max(len(list_intersect({TERMS3.format('statement')}, {TERMS3.format('e.text')}))), 0) AS best,
  count(*) FILTER (len(list_intersect({TERMS3.format('statement')}, {TERMS3.format('e.text')})) >= 2) AS supporters,
  count(*) FILTER (len(list_intersect({TERMS3.format('statement')}, {TERMS3.format('e.text')})) > 0) AS sources,
  coalesce(sum(len(list_intersect({TERMS3.format('statement')}, {TERMS3.format('e.text')}))), 0)::BIGINT AS shared,
  coalesce(bool_or(len(list_filter(regexp_split_to_array(statement, '\s+'), lambda w: length(w) >= 2 AND contains(e.text, w))) > 0), false) AS loose
  FROM {name}_st st LEFT JOIN evidence e USING (answer_id) GROUP BY st.answer_id, pos)"""


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("statements", f"WITH {EVIDENCE}, {support_sql('s', 6)} SELECT answer_id, pos, statement FROM s_st")
def statements(t):
    return ql.statement_rows(t.answers()).withColumn("pos", F.col("pos").cast("long"))


@query(
    "statement_support",
    f"WITH {EVIDENCE}, {support_sql('s', 6)} SELECT answer_id, pos, best, supporters, sources, shared, loose FROM s",
)
def statement_support(t):
    out = ql.statement_support(t.answers(), t.evidence())
    return out.select("answer_id", F.col("pos").cast("long"), F.col("best").cast("long"), "supporters", "sources", "shared", "loose")


COVER = f"""{support_sql('s', 6)}, cov AS (SELECT answer_id, count(*) AS statements, avg((best >= 2)::INT) AS source_coverage,
  avg(CASE WHEN pos < 5 THEN (supporters >= 2)::INT END) AS source_consistency FROM s GROUP BY answer_id)"""


@query("source_coverage", f"WITH {EVIDENCE}, {COVER} SELECT answer_id, statements, round(source_coverage, 6) AS source_coverage, round(source_consistency, 6) AS source_consistency FROM cov")
def source_coverage(t):
    return r6(ql.source_coverage(ql.statement_support(t.answers(), t.evidence())), "source_coverage", "source_consistency")


STRICT, VAGUE = ["the", "que", "die", "shall"], ["and", "und", "ou", "may"]
TYPES = [("requ|stand|the", "regulatory"), ("ing|ment", "method"), ("und|and", "comparison")]
TYPE_CASE = "CASE " + " ".join(f"WHEN regexp_matches(query, '{p}') THEN '{n}'" for p, n in TYPES) + " ELSE 'general' END"
SRC_RULES = [("src1", "CAAC"), ("src[23]", "FAA"), ("src4", "EASA")]
ANS_RULES = {"CAAC": "tion", "FAA": "zzq", "EASA": "heit"}


def n_matches(pattern: str, col: str = "answer") -> str:
    return f"len(regexp_extract_all({col}, '{pattern}'))"


PREC = f"({count_sql('answer', STRICT)}::DOUBLE / greatest({count_sql('answer', STRICT)} + {count_sql('answer', VAGUE)}, 1))"


@query(
    "answer_densities",
    f"""WITH {EVIDENCE}, {support_sql('s', 6)}, n AS (SELECT answer_id, count(*) AS n FROM s_st GROUP BY answer_id)
SELECT answer_id, round(least(len(regexp_extract_all(answer, '[A-Z][a-z]+'))::DOUBLE / n, 1.0), 6) AS citation_density,
  round(least({n_matches(ql.QUANTITY)}::DOUBLE / n, 1.0), 6) AS numeric_specificity, round({PREC}, 6) AS term_precision FROM answers JOIN n USING (answer_id)""",
)
def answer_densities(t):
    n = ql.statement_rows(t.answers()).groupBy("answer_id").agg(F.count("*").alias("n"))
    a = F.col("answer")
    return t.answers().join(n, "answer_id").select(
        "answer_id", F.round(ql.density(a, "[A-Z][a-z]+", F.col("n")), 6).alias("citation_density"),
        F.round(ql.density(a, ql.QUANTITY, F.col("n")), 6).alias("numeric_specificity"), F.round(ql.term_precision(a, STRICT, VAGUE), 6).alias("term_precision"))


AGENCY = """ag AS (SELECT answer_id, bool_or(authority = 'CAAC' OR source = 'src1') AS c, bool_or(authority = 'FAA' OR source IN ('src2', 'src3')) AS f,
  bool_or(authority = 'EASA' OR source = 'src4') AS e, bool_or(authority = 'OTHER') AS o,
  avg(CASE authority WHEN 'CAAC' THEN 1.0::DOUBLE WHEN 'FAA' THEN 0.95::DOUBLE WHEN 'EASA' THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END) AS m FROM evidence GROUP BY answer_id),
cr AS (SELECT a.answer_id, query, answer, (coalesce(c, false) OR contains(answer, 'tion'))::INT + (coalesce(f, false) OR contains(answer, 'zzq'))::INT + (coalesce(e, false) OR contains(answer, 'heit'))::INT
  + coalesce(o, false)::INT AS agencies, coalesce(m, 0.5::DOUBLE) AS authority_weight FROM answers a LEFT JOIN ag USING (answer_id))"""


@query("cross_regulation", f"WITH {EVIDENCE}, {AGENCY} SELECT answer_id, agencies::BIGINT AS agencies, least(agencies / 2.0::DOUBLE, 1.0) AS cross_regulation, round(authority_weight, 6) AS authority_weight FROM cr")
def cross_regulation(t):
    out = ql.cross_regulation(t.answers(), ql.evidence_agencies(t.evidence(), SRC_RULES), ANS_RULES)
    return out.select("answer_id", F.col("agencies").cast("long"), "cross_regulation", F.round("authority_weight", 6).alias("authority_weight"))


W_SQL = "CASE query_type " + " ".join(f"WHEN '{k}' THEN {[float(x) for x in v]}" for k, v in ql.WEIGHTS.items()) + " END"
CONF = f"""{COVER}, {AGENCY}, d AS (SELECT cr.answer_id, answer, {TYPE_CASE} AS query_type, coalesce(statements, 0) AS n, coalesce(source_coverage, 0) AS d1,
  CASE WHEN coalesce(statements, 0) = 0 THEN 0 ELSE least({n_matches(ql.CITATION)}::DOUBLE / statements, 1.0) END AS d2, {PREC} AS d3, least(agencies / 2.0::DOUBLE, 1.0) AS d4,
  CASE WHEN coalesce(statements, 0) = 0 THEN 0 ELSE least({n_matches(ql.QUANTITY)}::DOUBLE / statements, 1.0) END AS d5, authority_weight AS d6, coalesce(source_consistency, 0) AS d7
  FROM cr LEFT JOIN cov USING (answer_id)),
w AS (SELECT *, ({W_SQL})::DOUBLE[] AS w FROM d),
conf AS (SELECT *, CASE WHEN n = 0 THEN 0.5 ELSE round(greatest(0.15::DOUBLE, least(0.95::DOUBLE, d1 * w[1] + d2 * w[2] + d3 * w[3] + d4 * w[4] + d5 * w[5] + d6 * w[6] + d7 * w[7])) + 1e-9::DOUBLE, 4) END AS summary FROM w)"""


@query(
    "confidence",
    f"""WITH {EVIDENCE}, {CONF} SELECT answer_id, query_type, summary::DOUBLE AS summary, CASE WHEN summary >= 0.75 THEN 'high' WHEN summary >= 0.5 THEN 'medium' ELSE 'low' END AS level,
  CASE WHEN n = 0 THEN 'no_statements' ELSE concat_ws(',', CASE WHEN d1 < 0.5 THEN 'coverage' END, CASE WHEN d2 < 0.3 THEN 'citations' END, CASE WHEN d4 < 0.5 THEN 'cross_regulation' END,
   CASE WHEN d5 < 0.3 THEN 'numbers' END, CASE WHEN {count_sql('answer', VAGUE)} > 0 THEN 'vague' END, CASE WHEN d6 < 0.7 THEN 'authority' END, CASE WHEN d7 < 0.3 THEN 'consistency' END) END AS markers FROM conf""",
)
def confidence(t):
    return confident(t).select("answer_id", "query_type", "summary", "level", F.array_join("markers", ",").alias("markers"))


def confident(t: Tables):
    return ql.confidence(t.answers(), t.evidence(), TYPES, STRICT, VAGUE, SRC_RULES, ANS_RULES)


CL = "[A-Z][a-z]{2,}"
TM = "[A-Z][a-z]{1,5}"


def found_sql(name: str, pattern: str, title: bool = False) -> str:
    text = "concat_ws(chr(10), e.text, e.title)" if title else "e.text"
    return f"""{name}_i AS (SELECT answer_id, unnest(i) AS item, generate_subscripts(i, 1) AS pos FROM (SELECT answer_id, regexp_extract_all(answer, '{pattern}', {int(pattern.startswith('('))}) AS i FROM answers)),
{name} AS (SELECT i.answer_id, count(*) AS items, count(*) FILTER (EXISTS (SELECT 1 FROM evidence e WHERE e.answer_id = i.answer_id AND contains({text}, i.item))) AS found FROM {name}_i i GROUP BY i.answer_id)"""


TERMINOLOGY = "terminology AS (SELECT DISTINCT p_name AS text FROM part UNION SELECT text FROM benchmark)"
KNOWN = f"""kt AS (SELECT answer_id, unnest(regexp_extract_all(answer, '{TM}')) AS term FROM answers),
kk AS (SELECT term, EXISTS (SELECT 1 FROM terminology t WHERE contains(lower(t.text), lower(d.term))) AS known FROM (SELECT DISTINCT term FROM kt) d),
kn AS (SELECT answer_id, count(*) AS terms, count(*) FILTER (known) AS known, count(DISTINCT term) FILTER (NOT known) AS unknown FROM kt JOIN kk USING (term) GROUP BY answer_id)"""


def terminology(t: Tables):
    return t("part").select(F.col("p_name").alias("text")).union(t("benchmark").select("text")).distinct()


def equivalents(t: Tables):
    return t("benchmark").select(F.explode(tx.matches(F.col("text"), CL)).alias("clause")).distinct()


GRAPHN = "g AS (SELECT conv_id * 100 + turn AS answer_id, (length(text) % 7)::BIGINT AS nodes FROM conversations)"


@query(
    "confidence6",
    rf"""WITH {EVIDENCE}, {TERMINOLOGY}, {KNOWN}, {found_sql('cl', CL, True)}, {found_sql('nu', '[0-9]+(?:[.][0-9]+)?')}, {GRAPHN},
eqc AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{CL}')) AS clause FROM benchmark),
eq AS (SELECT answer_id, count(*) AS eq FROM cl_i WHERE item IN (SELECT clause FROM eqc) GROUP BY answer_id),
ch AS (SELECT e.answer_id, count(*) AS rows, sum(coalesce(length(list_filter(string_split(a.answer, '.'), lambda s: len(list_filter(regexp_split_to_array(trim(s), '\s+'), lambda w: length(w) >= 2 AND contains(e.text, w))) > 0)[1]), 0)) AS chars
  FROM evidence e JOIN answers a USING (answer_id) GROUP BY e.answer_id),
f AS (SELECT a.answer_id, least(coalesce(chars, 0)::DOUBLE / length(answer), 1.0) AS f1,
  CASE WHEN coalesce(ch.rows, 0) = 0 THEN 0 WHEN coalesce(cl.items, 0) = 0 THEN 0.5 ELSE cl.found::DOUBLE / cl.items END AS f2, CASE WHEN coalesce(cl.items, 0) = 0 THEN 0 ELSE least(coalesce(eq, 0)::DOUBLE / cl.items, 1.0) END AS f3,
  least(coalesce(nodes, 0) / 5.0::DOUBLE, 1.0) AS f4, CASE WHEN coalesce(terms, 0) = 0 THEN 0.5 ELSE known::DOUBLE / terms END AS f5,
  CASE WHEN coalesce(ch.rows, 0) = 0 OR coalesce(nu.items, 0) = 0 THEN 0 ELSE nu.found::DOUBLE / nu.items END AS f6
  FROM answers a LEFT JOIN ch USING (answer_id) LEFT JOIN cl USING (answer_id) LEFT JOIN eq USING (answer_id) LEFT JOIN nu USING (answer_id) LEFT JOIN kn USING (answer_id) LEFT JOIN g USING (answer_id)),
c AS (SELECT *, f1 * 0.30::DOUBLE + f2 * 0.20::DOUBLE + f3 * 0.15::DOUBLE + f4 * 0.15::DOUBLE + f5 * 0.10::DOUBLE + f6 * 0.10::DOUBLE AS confidence FROM f)
SELECT answer_id, round(confidence, 6) AS confidence, CASE WHEN confidence >= 0.8 THEN 'HIGH' WHEN confidence >= 0.6 THEN 'MEDIUM' WHEN confidence >= 0.4 THEN 'LOW' ELSE 'VERY_LOW' END AS level,
  round(f1, 6)::DOUBLE AS citation_coverage, round(f5, 6)::DOUBLE AS term_consistency FROM c""",
)
def confidence6(t):
    g = t("conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("answer_id"), (F.length("text") % 7).alias("nodes"))
    out = ql.confidence6(t.answers(), t.evidence(), equivalents(t), g, terminology(t), "\\.", CL, TM)
    return r6(out.select("answer_id", "confidence", "level", "citation_coverage", "term_consistency"), "confidence", "citation_coverage", "term_consistency")


@query(
    "confidence5",
    f"""WITH {EVIDENCE}, s AS (SELECT answer_id, avg(length(text)) AS size FROM evidence GROUP BY answer_id),
c AS (SELECT answer_id, least(coalesce(size, 0) / 500::DOUBLE, 1.0) * 0.30::DOUBLE + least({n_matches(CL)} / 3.0::DOUBLE, 1.0) * 0.25::DOUBLE + CASE WHEN contains(answer, 'tion') THEN 0.2::DOUBLE ELSE 0 END
  + CASE WHEN contains(answer, 'heit') THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN contains(answer, 'que') THEN 0.1::DOUBLE ELSE 0 END AS confidence FROM answers LEFT JOIN s USING (answer_id))
SELECT answer_id, round(confidence, 6) AS confidence, CASE WHEN confidence >= 0.7 THEN 'HIGH' WHEN confidence >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM c""",
)
def confidence5(t):
    a = F.col("answer")
    added = t.answers().select("answer_id", a.contains("tion").alias("equivalents"), a.contains("heit").alias("terms"), a.contains("que").alias("links"))
    return r6(ql.confidence5(t.answers(), t.evidence(), added, CL), "confidence")


ABS = ["the [a-z]+ of", "que la"]
SUPPORT_WORDS = ["with", "pour", "nicht"]
RISK = f"""{TERMINOLOGY}, {KNOWN}, {support_sql('s5', 5)}, {found_sql('nu', '([a-z]+)tion')},
su AS (SELECT answer_id, count(*) AS statements, count(*) FILTER (NOT loose) AS unsupported FROM s5 GROUP BY answer_id),
bk AS (SELECT answer_id, bool_or({any_sql('text', SUPPORT_WORDS)}) AS backed FROM evidence GROUP BY answer_id),
rk AS (SELECT a.answer_id, coalesce(unsupported::DOUBLE / statements, 0) * 0.4::DOUBLE AS outside,
  CASE WHEN coalesce(backed, false) THEN 0 ELSE ({' + '.join(n_matches(p) for p in ABS)}) * 0.05::DOUBLE END AS absolute, coalesce(unknown::DOUBLE / terms, 0) * 0.15::DOUBLE AS unknown_terms,
  coalesce((nu.items - nu.found)::DOUBLE / nu.items, 0) * 0.15::DOUBLE AS number_mismatch, CASE WHEN contains(answer, 'would') OR contains(answer, 'les') THEN CASE WHEN contains(lower(answer), 'maybe') OR contains(lower(answer), 'une') THEN 0 ELSE 0.1::DOUBLE END ELSE 0 END AS speculation
  FROM answers a LEFT JOIN su USING (answer_id) LEFT JOIN bk USING (answer_id) LEFT JOIN kn USING (answer_id) LEFT JOIN nu USING (answer_id)),
risks AS (SELECT *, least(outside + absolute + unknown_terms + number_mismatch + speculation, 1.0) AS risk FROM rk)"""


@query(
    "hallucination_risk",
    f"WITH {EVIDENCE}, {RISK} SELECT answer_id, round(outside, 6) AS outside, round(absolute, 6)::DOUBLE AS absolute, round(unknown_terms, 6) AS unknown_terms, round(number_mismatch, 6) AS number_mismatch, speculation::DOUBLE AS speculation, round(risk, 6)::DOUBLE AS risk FROM risks",
)
def hallucination_risk(t):
    return r6(risky(t), "outside", "absolute", "unknown_terms", "number_mismatch", "risk")


def risky(t: Tables):
    return ql.hallucination_risk(t.answers(), t.evidence(), terminology(t), ABS, SUPPORT_WORDS, ["would", "les"], ["maybe", "une"], TM, "([a-z]+)tion")


@query(
    "risk_items",
    f"""WITH {EVIDENCE}, {support_sql('s5', 5)}, {found_sql('nu', '([a-z]+)tion')}, {found_sql('cm', '(the [a-z]+ of)', True)},
n AS (SELECT answer_id, 'source_outside' AS type, 'high' AS severity, least(count(*) FILTER (NOT loose), 5) AS n, 0.3::DOUBLE AS p, 5 AS f FROM s5 GROUP BY answer_id
 UNION ALL SELECT answer_id, 'unverified_numbers', 'medium', items - found, 0.15::DOUBLE, 3 FROM nu UNION ALL SELECT answer_id, 'absolute_claims', 'high', least(items - found, 5), 0.25::DOUBLE, 3 FROM cm
 UNION ALL SELECT answer_id, 'unknown_terms', 'low', least({n_matches('[A-Z][a-z]{5,8}')}, 5), 0.1::DOUBLE, 5 FROM answers
 UNION ALL SELECT answer_id, 'missing_citations', 'medium', (length(answer) > 100 AND NOT regexp_matches(answer, 'tion'))::BIGINT, 0.2::DOUBLE, 1 FROM answers)
SELECT answer_id, type, severity, n::BIGINT AS count, round(least(n / f::DOUBLE, 1.0) * p, 6) AS points FROM n WHERE n > 0""",
)
def risk_items(t):
    return r6(ql.risk_items(t.answers(), t.evidence(), "([a-z]+)tion", "(the [a-z]+ of)", "[A-Z][a-z]{5,8}", "tion"), "points")


@query(
    "fact_check",
    f"""WITH {EVIDENCE}, {support_sql('s', 6)}, c AS (SELECT answer_id, pos, sources > 0 AS supported, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + shared * 0.1::DOUBLE
  + CASE WHEN regexp_matches(statement, '(?i)tion') AND sources > 0 THEN 0.3::DOUBLE ELSE 0 END - CASE WHEN {any_sql('statement', ['the', 'que'])} AND sources = 0 THEN 0.2::DOUBLE ELSE 0 END)) AS confidence FROM s WHERE length(statement) >= 10)
SELECT answer_id, pos, supported, round(confidence, 6) AS confidence, NOT supported OR confidence < 0.5 AS flagged FROM c""",
)
def fact_check(t):
    out = ql.fact_check(t.answers(), t.evidence(), ["the", "que"], "(?i)tion")
    return r6(out, "confidence").select("answer_id", F.col("pos").cast("long"), "supported", "confidence", "flagged")


@query(
    "fact_table",
    rf"""WITH {SECTIONS} SELECT doc, number, node_id, regexp_matches(text, '\d+') AS has_numbers, regexp_matches(text, '\d+%') AS has_percent, regexp_matches(text, '\d+°[CF]') AS has_temperature,
  regexp_matches(text, '\d+\s*(?:秒|分钟|小时)') AS has_time, {any_sql('text', ['metal', 'stein'])} AS has_material FROM sections""",
)
def fact_table(t):
    return ql.fact_table(t.sections(), ["metal", "stein"])


PARAMS = {"percent": r"(\d+)\s*%", "dotted": r"(\d+)\.", "price": r"(\d+)\s*[$#&]"}
_P = " UNION ALL ".join(f"SELECT node_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}', 1)) AS value FROM sections" for k, p in PARAMS.items())


@query("parameters", f"WITH {SECTIONS} {_P}")
def parameters(t):
    return ql.parameters(t.sections(), PARAMS)


@query(
    "grounding_verdict",
    f"""WITH {EVIDENCE}, a AS (SELECT answer_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(answer), '[a-z0-9]+'), lambda w: length(w) > 2))) AS token FROM answers),
e AS (SELECT DISTINCT answer_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 2)) AS token FROM evidence),
o AS (SELECT a.answer_id, count(e.token)::DOUBLE / count(*) AS overlap FROM a LEFT JOIN e USING (answer_id, token) GROUP BY a.answer_id)
SELECT x.answer_id, round(coalesce(overlap, 0), 6) AS overlap, CASE WHEN x.answer_id NOT IN (SELECT answer_id FROM evidence) THEN 'NOT_FOUND' WHEN overlap >= 0.6 THEN 'PASS' WHEN overlap >= 0.3 THEN 'PARTIAL' ELSE 'UNVERIFIED' END AS verdict
FROM answers x LEFT JOIN o USING (answer_id)""",
)
def grounding_verdict(t):
    return r6(ql.grounding_verdict(t.answers(), t.evidence()), "overlap")


@query(
    "safety_score",
    f"""WITH {EVIDENCE}, {support_sql('s5', 5)}, v AS (SELECT answer_id, avg(loose::INT) AS v FROM s5 GROUP BY answer_id)
SELECT answer_id, round(coalesce(v, 1), 6) AS verified, round(coalesce(v, 1) * CASE WHEN contains(answer, 'que') THEN 1.0 ELSE 0.9::DOUBLE END * CASE WHEN regexp_matches(answer, 'tion') THEN 1.0 ELSE 0.85::DOUBLE END, 6) AS safety
FROM answers LEFT JOIN v USING (answer_id)""",
)
def safety_score(t):
    return r6(ql.safety_score(t.answers(), t.evidence(), ["que"], "tion"), "verified", "safety")


USAB = """us AS (SELECT answer_id, sum((coalesce(source, '') <> '')::INT + (coalesce(section, '') <> '')::INT + (coalesce(title, '') <> '')::INT)::DOUBLE / (count(*) * 3) AS m, least(avg(length(text)) / 500::DOUBLE, 1.0) AS l FROM evidence GROUP BY answer_id),
use AS (SELECT a.answer_id, CASE WHEN m IS NULL THEN 0 ELSE m * 0.30::DOUBLE + l * 0.25::DOUBLE + CASE WHEN contains(answer, 'tion') THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN contains(answer, 'heit') THEN 0.075::DOUBLE ELSE 0 END
  + CASE WHEN contains(answer, 'que') THEN 0.1::DOUBLE ELSE 0 END END AS usability FROM answers a LEFT JOIN us USING (answer_id))"""


def usable(t: Tables):
    a = F.col("answer")
    num = lambda w, v: F.when(a.contains(w), v).otherwise(0.0)
    flags = t.answers().select("answer_id", num("tion", 1.0).alias("graph"), num("heit", 0.5).alias("links"), num("que", 1.0).alias("terms"))
    return ql.usability(t.answers(), t.evidence(), flags)


@query(
    "usability",
    f"WITH {EVIDENCE}, {USAB} SELECT answer_id, round(usability, 6) AS usability, CASE WHEN usability >= 0.8 THEN 'EXCELLENT' WHEN usability >= 0.6 THEN 'GOOD' WHEN usability >= 0.4 THEN 'FAIR' ELSE 'POOR' END AS level FROM use",
)
def usability(t):
    return r6(usable(t), "usability")


@query(
    "overall_quality",
    f"""WITH {EVIDENCE}, {CONF}, {RISK}, {USAB}, q AS (SELECT answer_id, (summary * 0.4::DOUBLE + (1 - risk) * 0.3::DOUBLE + usability * 0.3::DOUBLE) * 100 AS quality FROM conf JOIN risks USING (answer_id) JOIN use USING (answer_id))
SELECT answer_id, round(quality, 6) AS quality, CASE WHEN quality >= 80 THEN 'A' WHEN quality >= 70 THEN 'B' WHEN quality >= 60 THEN 'C' WHEN quality >= 50 THEN 'D' ELSE 'F' END AS grade FROM q""",
)
def overall_quality(t):
    scores = confident(t).select("answer_id", F.col("summary").alias("confidence")).join(risky(t).select("answer_id", "risk"), "answer_id").join(
        usable(t).select("answer_id", "usability"), "answer_id")
    return ql.overall_quality(scores).withColumn("quality", F.round("quality", 6))


SENT = r"list_transform(regexp_split_to_array(regexp_replace(regexp_replace({0}, '\s+', ' ', 'g'), '^ +| +$', '', 'g'), '[.]'), lambda s: " + STRIP.format("s") + ")"
REQ = ["that", "pour", "nicht", "para"]


@query(
    "key_sentences",
    f"""WITH {EVIDENCE}, s AS (SELECT answer_id, rank, {SENT.format('text')} AS s FROM evidence),
k AS (SELECT answer_id, rank, list_filter(s, lambda x: length(x) >= 5 AND {any_sql('x', REQ)}) AS key, list_filter(s[1:3], lambda x: length(x) > 0) AS plain FROM s),
c AS (SELECT answer_id, rank, CASE WHEN len(key) > 0 THEN key[1:8] ELSE plain END AS c FROM k)
SELECT answer_id, rank, generate_subscripts(c, 1) - 1 AS pos, unnest(c) AS sentence FROM c""",
)
def key_sentences(t):
    return an.key_sentences(t.evidence(), REQ, "[.]").withColumn("pos", F.col("pos").cast("long"))


@query(
    "direct_answer",
    rf"""WITH {EVIDENCE}, b AS (SELECT answer_id, arg_min(text, rank) AS text, max(answer_id % 2) AS odd FROM evidence GROUP BY answer_id)
SELECT answer_id, CASE WHEN odd = 1 AND len(regexp_extract_all(text, '\d+(?:\.\d+)?%?')) > 0 THEN array_to_string(regexp_extract_all(text, '\d+(?:\.\d+)?%?')[1:5], ', ')
  ELSE coalesce({STRIP.format("list_filter(string_split(text, '.'), lambda s: length(s) > 15 AND length(s) < 200)[1]")}, substr(text, 1, 200)) END AS direct FROM b""",
)
def direct_answer(t):
    intents = t.answers().select("answer_id", F.when(F.col("answer_id") % 2 == 1, "numerical").otherwise("definition").alias("intent"))
    return an.direct_answer(t.evidence(), intents, "\\.")


@query(
    "evidence_digest",
    f"""WITH {EVIDENCE}, n AS (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY rank) AS num FROM evidence)
SELECT answer_id, string_agg(num || '. [' || source || '] (' || CASE WHEN relevance >= 0.8 THEN 'high' WHEN relevance >= 0.5 THEN 'medium' ELSE 'low' END || ') ' || substr(text, 1, 300), chr(10) ORDER BY num) AS digest
FROM n WHERE num <= 5 GROUP BY answer_id""",
)
def evidence_digest(t):
    return an.evidence_digest(t.evidence())


WORDS = "list_distinct(regexp_extract_all(lower({0}), '[a-z]+'))"


@query(
    "overlap_snippets",
    f"""WITH {EVIDENCE}, weak AS (SELECT answer_id FROM evidence GROUP BY answer_id HAVING max(relevance) < 0.6),
p AS (SELECT answer_id, rank, source, unnest(l) AS s, generate_subscripts(l, 1) AS pos, list_filter({WORDS.format('query')}, lambda w: length(w) >= 2) AS keys
  FROM (SELECT e.*, a.query, string_split(e.text, '.') AS l FROM evidence e JOIN answers a USING (answer_id) WHERE rank <= 3 AND e.answer_id IN (SELECT answer_id FROM weak))),
o AS (SELECT *, len(list_intersect(keys, {WORDS.format('s')})) AS overlap FROM p WHERE length(s) > 20),
r AS (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY overlap DESC, rank, pos) AS num FROM o WHERE overlap >= 1)
SELECT answer_id, num, source, {STRIP.format('s')} AS sentence, overlap::BIGINT AS overlap FROM r WHERE num <= 3""",
)
def overlap_snippets(t):
    out = an.overlap_snippets(t.answers(), t.evidence(), "\\.", 3, 0.6)
    return out.withColumns({"num": F.col("num").cast("long"), "overlap": F.col("overlap").cast("long")})


@query(
    "safe_summary",
    f"""WITH {EVIDENCE}, n AS (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY rank) AS num, source || CASE WHEN coalesce(section, '') <> '' THEN ' §' || section ELSE '' END AS ref FROM evidence),
c AS (SELECT answer_id, arg_min(substr(coalesce(title, '') || ': ' || array_to_string(list_filter({SENT.format('text')}, lambda s: length(s) > 0)[1:3], '. '), 1, 500), num) AS core, list(ref ORDER BY num) AS r FROM n WHERE num <= 3 GROUP BY answer_id)
SELECT answer_id, '{an.SAFE_MARKER}，' || core || ' [' || r[1] || ']' || CASE WHEN len(r) > 1 THEN ' | ' || array_to_string(r[2:3], '; ') ELSE '' END AS summary FROM c""",
)
def safe_summary(t):
    return an.safe_summary(t.evidence(), "[.]")


def forms(t: Tables):
    w = tx.matches(F.col("text"), "[a-z]{4,}")
    return t("benchmark").select(w[0].alias("term"), w[1].alias("expansion")).filter("term is not null and expansion is not null").distinct()


@query(
    "term_notes",
    f"""WITH {ANSWERS}, f AS (SELECT DISTINCT w[1] AS term, w[2] AS expansion FROM (SELECT regexp_extract_all(text, '[a-z]{{4,}}') AS w FROM benchmark) WHERE len(w) >= 2),
o AS (SELECT answer_id, term, min(pos) AS pos FROM (SELECT answer_id, unnest(l) AS term, generate_subscripts(l, 1) AS pos FROM (SELECT answer_id, regexp_extract_all(answer, '[a-z]{{4,}}') AS l FROM answers)) GROUP BY ALL),
r AS (SELECT answer_id, term, expansion, row_number() OVER (PARTITION BY answer_id ORDER BY pos, expansion) AS num FROM o JOIN f USING (term))
SELECT * FROM r WHERE num <= 3""",
)
def term_notes(t):
    return an.term_notes(t.answers(), forms(t), "[a-z]{4,}").withColumn("num", F.col("num").cast("long"))


@query(
    "missing_references",
    f"""WITH {EVIDENCE}, refs AS (SELECT answer_id, section, min(rank) AS rank FROM evidence WHERE coalesce(section, '') <> '' GROUP BY ALL),
m AS (SELECT r.answer_id, section, row_number() OVER (PARTITION BY r.answer_id ORDER BY rank, section) AS num FROM refs r JOIN answers a USING (answer_id) WHERE NOT contains(answer, section)),
eq AS (SELECT DISTINCT section, 'E' || section AS other FROM evidence WHERE section IS NOT NULL),
x AS (SELECT answer_id, other, min(num) AS n FROM m JOIN eq USING (section) WHERE num <= 5 GROUP BY ALL),
y AS (SELECT answer_id, other, row_number() OVER (PARTITION BY answer_id ORDER BY n, other) AS num FROM x)
SELECT answer_id, num, section, 'missing' AS kind FROM m WHERE num <= 5 UNION ALL SELECT answer_id, num, other, 'equivalent' FROM y WHERE num <= 3""",
)
def missing_references(t):
    eq = t.evidence().filter("section is not null").select("section", F.concat(F.lit("E"), "section").alias("other")).distinct()
    return an.missing_references(t.answers(), t.evidence(), eq).withColumn("num", F.col("num").cast("long"))
