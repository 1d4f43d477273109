"""Answer-quality and grounding scores.

answers(answer_id, query, answer); evidence(answer_id, rank, text, source, authority, title, section).
Evidence rows stay rows: each is compared with the statements of its answer inside one row, and only counters
are combined per answer, so no answer's evidence is ever collected in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.functions import text as tx
from clausemill.functions.scale import salted_join, stored
from clausemill.operators.rules import QUERY_TYPES, query_type

# Patterns, word lists, weights and thresholds of the scores.
CITATION = r"(?i)(?:§|第|section|CCAR|FAR|CS)\s*[\d.\-]+|(?:33|25|29|91)\.\d+"
QUANTITY = r"\d+(?:\.\d+)?(?:\s*%|℃|°C|rpm|MPa|kN|kg|mm|m/s|nm|bar|psi)?"
STRICT = ["必须", "应当", "不得", "不低于", "不超过", "至少", "最大", "最小", "shall", "must", "required", "minimum", "maximum"]
VAGUE = ["可能", "大概", "也许", "一般", "通常", "据说", "似乎", "may", "might", "perhaps", "generally", "usually"]
ANSWER_AGENCIES = {"CAAC": r"(?i)CCAR|中国民航|CAAC", "FAA": r"(?i)FAR|FAA|AC.33|美国联邦", "EASA": r"(?i)CS-|EASA|欧洲航空"}
AUTHORITY = {"CAAC": 1.0, "FAA": 0.95, "EASA": 0.90, "OTHER": 0.70}
DIMENSIONS = [
    "source_coverage", "citation_density", "term_precision", "cross_regulation", "numeric_specificity", "authority_weight",
    "source_consistency",
]
WEIGHTS = {
    "regulatory": [0.25, 0.20, 0.15, 0.15, 0.10, 0.10, 0.05],
    "method": [0.25, 0.10, 0.15, 0.10, 0.10, 0.15, 0.15],
    "comparison": [0.20, 0.10, 0.10, 0.25, 0.05, 0.15, 0.15],
    "general": [0.25, 0.15, 0.15, 0.10, 0.10, 0.15, 0.10],
}
CLAUSE = r"§\s*[\d.]+|第\s*[\d.]+\s*条|[\d.]+\s*条"
TERM = r"[一-鿿]{2,6}|[A-Z]{2,6}"
UNIT_NUMBER = r"(\d+(?:\.\d+)?)\s*(?:%|分钟|小时|度)"
RISK_NUMBER = r"(\d+(?:\.\d+)?)\s*(?:%|度|分钟|小时|秒|次|个|项|条|节|章|mm|cm|m|kg|lb)"
ABSOLUTE = [r"是.*的(?!必须|应当|要求)", r"有.*的(?!必须|应当|要求)", r"为.*的(?!必须|应当|要求)"]
ABSOLUTE_CLAIM = r"是\s*([^　-〿，。]{2,10})\s*的"
ABSOLUTE_SUPPORT = ["必须", "应当"]
UNCERTAIN = ["可能", "或许", "大约", "估计", "推测", "maybe", "possibly"]
SPECULATIVE = ["应该", "可能", "估计"]
HAS_CITATION = r"§|第\s*\d+\s*条|参考文献|来源|CCAR|FAR|CS-"
SAFE_CITATION = r"参考文献|§|第\s*\d+\s*条"
SAFE_MARKERS = ["通常情况下", "根据相关条款", "基于当前知识库", "可能需要", "应参考具体规章"]
PARAMETERS = {
    "seconds": r"(\d+)\s*秒", "minutes": r"(\d+)\s*分钟", "hours": r"(\d+)\s*小时", "percent": r"(\d+)\s*%", "temperature": r"(\d+)\s*°[CFc]",
}


def statement_rows(answers: DataFrame, min_len: int = 6) -> DataFrame:
    """V1: one row per statement with its position."""
    return answers.select("answer_id", F.posexplode(tx.statements(F.col("answer"), min_len)).alias("pos", "statement"))


def statement_support(answers: DataFrame, evidence: DataFrame, min_len: int = 6) -> DataFrame:
    """Per statement: best shared-term count, number of evidence rows with two or more (`supporters`) or any
    (`sources`) shared terms, all shared terms, and whether any word of two or more characters occurs (`loose`)."""
    st = answers.select("answer_id", tx.statements(F.col("answer"), min_len).alias("_s")).filter(F.size("_s") > 0)
    st = st.withColumns(
        {
            "_t": F.transform("_s", tx.evidence_terms),
            "_w": F.transform("_s", lambda s: F.filter(F.split(s, r"\s+"), lambda w: F.length(w) >= 2)),
        }
    )
    ev = evidence.select("answer_id", "rank", "text", tx.evidence_terms(F.col("text")).alias("_e"))
    per = salted_join(ev, st, ["answer_id"], spread="rank").select(
        "answer_id",
        F.posexplode(
            F.zip_with("_t", "_w", lambda t, w: F.struct(
                F.size(F.array_intersect(t, F.col("_e"))).alias("o"),
                F.exists(w, lambda x: F.col("text").contains(x)).alias("l")))
        ).alias("pos", "x"),
    )
    counted = per.groupBy("answer_id", "pos").agg(
        F.max("x.o").alias("best"), F.count_if(F.col("x.o") >= 2).alias("supporters"),
        F.count_if(F.col("x.o") > 0).alias("sources"), F.sum("x.o").alias("shared"), F.max("x.l").alias("loose"),
    )
    rows = st.select("answer_id", F.posexplode("_s").alias("pos", "statement"))
    return rows.join(counted, ["answer_id", "pos"], "left").fillna(0, ["best", "supporters", "sources", "shared"]).fillna(False, ["loose"])


def once(answers: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables stored, for scores that read them several times; their own derivation then runs once."""
    return stored(answers, "answers"), stored(evidence, "evidence")


def source_coverage(support: DataFrame) -> DataFrame:
    """V2 and the second half of V6: coverage, and consistency over the first five statements."""
    first = F.col("pos") < 5
    return support.groupBy("answer_id").agg(
        F.count("*").alias("statements"), F.avg((F.col("best") >= 2).cast("double")).alias("source_coverage"),
        F.avg(F.when(first, (F.col("supporters") >= 2).cast("double"))).alias("source_consistency"),
    )


def density(text: Column, pattern: str, statements: Column) -> Column:
    """V3: matches per statement, at most 1."""
    return F.least(tx.ratio(F.regexp_count(text, F.lit(pattern)), F.greatest(statements, F.lit(1))), F.lit(1.0))


def term_precision(text: Column, strict: list[str] = STRICT, vague: list[str] = VAGUE) -> Column:
    """V4: strict words over strict and vague words."""
    s, v = tx.count_contained(text, strict), tx.count_contained(text, vague)
    return tx.ratio(s, F.greatest(s + v, F.lit(1)))


def evidence_agencies(evidence: DataFrame, source_rules: list[tuple[str, str]], count_other: bool = True) -> DataFrame:
    """Per answer: which agencies the evidence names (by source, first rule wins, and by authority), mean weight, length."""
    by_source = F
    for pattern, agency in source_rules:
        by_source = by_source.when(F.col("source").rlike(pattern), agency)
    by_source = by_source.otherwise(None)
    flags = []
    for a in AUTHORITY:
        hit = F.col("authority") == a
        if a == "OTHER" and not count_other:
            hit = F.lit(False)
        flags.append(F.max((F.coalesce(by_source == a, F.lit(False)) | F.coalesce(hit, F.lit(False))).cast("int")).alias(f"_{a}"))
    weight = F.lit(AUTHORITY["OTHER"])
    for a, w in AUTHORITY.items():
        weight = F.when(F.col("authority") == a, w).otherwise(weight)
    return evidence.groupBy("answer_id").agg(*flags, F.avg(weight).alias("authority_mean"), F.count("*").alias("evidence_rows"))


SOURCE_RULES = [("CCAR", "CAAC"), ("FAR|(?i)AC_33", "FAA"), ("CS|EASA", "EASA")]


def cross_regulation(answers: DataFrame, agencies: DataFrame, answer_rules: dict[str, str] = ANSWER_AGENCIES) -> DataFrame:
    """V5: distinct agencies in answer or evidence, halved, at most 1. Adds authority_mean (0.5 without evidence)."""
    rows = answers.join(agencies, "answer_id", "left")
    n = F.lit(0)
    for a in AUTHORITY:
        said = F.col("answer").rlike(answer_rules[a]) if a in answer_rules else F.lit(False)
        n = n + (said | (F.coalesce(F.col(f"_{a}"), F.lit(0)) == 1)).cast("int")
    return rows.withColumns(
        {"agencies": n, "cross_regulation": F.least(n / 2.0, F.lit(1.0)), "authority_weight": F.coalesce("authority_mean", F.lit(0.5))}
    ).drop(*[f"_{a}" for a in AUTHORITY], "authority_mean")


def confidence(answers: DataFrame, evidence: DataFrame, types: list[tuple[str, str]] = QUERY_TYPES, strict=STRICT, vague=VAGUE,
               source_rules=SOURCE_RULES, answer_rules=ANSWER_AGENCIES, weights=WEIGHTS) -> DataFrame:
    """V7: seven dimensions, weighted by query type, clamped to .15-.95; 0.5 where no statement can be cut."""
    cov = source_coverage(statement_support(answers, evidence))
    rows = cross_regulation(answers, evidence_agencies(evidence, source_rules), answer_rules).join(cov, "answer_id", "left")
    n = F.coalesce("statements", F.lit(0))
    a = F.col("answer")
    rows = rows.withColumns(
        {
            "query_type": query_type(F.col("query"), types),
            "source_coverage": F.coalesce("source_coverage", F.lit(0.0)),
            "source_consistency": F.coalesce("source_consistency", F.lit(0.0)),
            "citation_density": density(a, CITATION, n),
            "numeric_specificity": density(a, QUANTITY, n),
            "term_precision": term_precision(a, strict, vague),
            "vague_words": tx.count_contained(a, vague),
            "statements": n,
        }
    )
    table = F.create_map(*[x for t, w in weights.items() for x in (F.lit(t), F.array(*[F.lit(v) for v in w]))])
    w = F.element_at(table, F.col("query_type"))
    total = sum((F.col(d) * w[i] for i, d in enumerate(DIMENSIONS)), F.lit(0.0))
    # The 1e-9 makes sums that are a half in the fifth place round up whatever their binary form.
    summary = F.when(n == 0, 0.5).otherwise(F.round(tx.clip(total, 0.15, 0.95) + 1e-9, 4))
    rows = rows.withColumn("summary", summary)
    mark = lambda cond, name: F.when(cond, name)
    markers = F.array_compact(F.array(
        mark(F.col("source_coverage") < 0.5, "coverage"), mark(F.col("citation_density") < 0.3, "citations"),
        mark(F.col("cross_regulation") < 0.5, "cross_regulation"), mark(F.col("numeric_specificity") < 0.3, "numbers"),
        mark(F.col("vague_words") > 0, "vague"), mark(F.col("authority_weight") < 0.7, "authority"),
        mark(F.col("source_consistency") < 0.3, "consistency"),
    ))
    return rows.withColumns({"markers": F.when(n == 0, F.array(F.lit("no_statements"))).otherwise(markers),
                             "level": tx.ladder(F.col("summary"), [(0.75, "high"), (0.5, "medium")], "low")})


def found_in_evidence(answers: DataFrame, evidence: DataFrame, items: Column, with_title: bool = False) -> DataFrame:
    """Per answer: how many of the extracted items occur in some evidence text (or title). Items keep their repeats."""
    rows = answers.select("answer_id", items.alias("_i")).filter(F.size("_i") > 0)
    text = F.concat_ws("\n", "text", "title") if with_title else F.col("text")
    hits = salted_join(evidence.select("answer_id", "rank", text.alias("_x")), rows, ["answer_id"], spread="rank").select(
        "answer_id", F.explode(F.filter(F.transform("_i", lambda v, i: F.struct(i.alias("pos"), v.alias("item"))), lambda x: F.col("_x").contains(x["item"]))).alias("h")
    ).select("answer_id", "h.pos")
    found = hits.groupBy("answer_id", "pos").agg(F.lit(1).alias("one")).groupBy("answer_id").agg(F.count("*").alias("found"))
    return rows.select("answer_id", F.size("_i").alias("items")).join(found, "answer_id", "left").fillna(0, ["found"])


SEED = 4  # characters of a term that look it up; a shorter term is its own seed
SEED_SAMPLE = 2000  # terminology texts in which the frequency of seeds is looked at
SEED_LIST = 20_000  # up to so many seeds are tested inside the row, more by a join


def contained_terms(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct keys of `terms`(key) that occur in a text of `texts`(text), lower-cased.

    Every term has one seed, its part of SEED characters that is rarest in a bounded sample of the texts. Of a text's parts only
    those that are seeds become rows; the whole term is then tested in the text.
    """
    keys = terms.select("key").filter("key <> ''").distinct()
    lowered = texts.select(F.lower("text").alias("text")).filter(F.col("text").isNotNull())
    grams = lambda c: F.array_distinct(F.when(F.length(c) < SEED, F.array(F.col(c))).otherwise(tx.char_ngrams(F.col(c), SEED)))
    sample = lowered.orderBy(F.xxhash64("text")).limit(SEED_SAMPLE).select(F.explode(F.array_distinct(tx.char_ngrams(F.col("text"), SEED))).alias("seed"))
    often = sample.groupBy("seed").agg(F.count("*").alias("df"))
    parts = keys.select("key", F.explode(grams("key")).alias("seed")).join(often, "seed", "left")
    rarest = F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "seed")).alias("s")
    seeded = stored(parts.groupBy("key").agg(rarest).select("key", "s.seed"), "term-seeds")
    seeds = stored(seeded.select("seed").distinct(), "seeds")
    lengths = sorted(r[0] for r in seeds.select(F.length("seed")).distinct().collect())  # 1 to SEED
    if not lengths:
        return keys
    own = F.array_distinct(F.concat(*[tx.char_ngrams(F.col("text"), n) for n in lengths]))
    head = seeds.limit(SEED_LIST + 1).collect()
    if len(head) <= SEED_LIST:
        found = lowered.select("text", F.explode(F.array_intersect(own, F.lit([r.seed for r in head]))).alias("seed"))
    else:
        found = lowered.select("text", F.explode(own).alias("seed")).join(seeds, "seed", "left_semi")
    return salted_join(found, seeded, ["seed"], spread="text").filter(F.col("text").contains(F.col("key"))).select("key").distinct()


def known_terms(answers: DataFrame, terminology: DataFrame, pattern: str = TERM) -> DataFrame:
    """Per answer: terms matched by the pattern, how many are known (contained in a terminology text), distinct unknown."""
    terms = answers.select("answer_id", F.posexplode(tx.matches(F.col("answer"), pattern)).alias("pos", "term")).withColumn("key", F.lower("term"))
    known = contained_terms(terms, terminology).withColumn("known", F.lit(True))
    rows = salted_join(terms, known, ["key"], spread="answer_id", how="left")
    per = rows.groupBy("answer_id", "term").agg(F.count("*").alias("n"), F.max("known").alias("known"))
    return per.groupBy("answer_id").agg(
        F.sum("n").alias("terms"), F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("known"),
        F.count_if(F.col("known").isNull()).alias("unknown"),
    )


def confidence6(answers: DataFrame, evidence: DataFrame, equivalents: DataFrame, graph: DataFrame, terminology: DataFrame,
                sentence_end: str = "。", clause: str = CLAUSE, term: str = TERM) -> DataFrame:
    """V8: six factors. equivalents(clause), graph(answer_id, nodes), terminology(text)."""
    answers, evidence = once(answers, evidence)
    # First sentence of the answer that shares a word with an evidence row, summed over the evidence.
    parts = answers.select("answer_id", F.split("answer", sentence_end).alias("_s"))
    per = salted_join(evidence.select("answer_id", "rank", "text"), parts, ["answer_id"], spread="rank")
    hit = F.get(F.filter("_s", lambda s: F.exists(F.split(F.trim(s), r"\s+"), lambda w: (F.length(w) >= 2) & F.col("text").contains(w))), F.lit(0))
    chars = per.groupBy("answer_id").agg(F.sum(F.coalesce(F.length(hit), F.lit(0))).alias("chars"), F.count("*").alias("rows"))
    clauses = found_in_evidence(answers, evidence, tx.matches(F.col("answer"), clause), True).select(
        "answer_id", F.col("items").alias("clauses"), F.col("found").alias("clauses_found"))
    eq = answers.select("answer_id", F.explode(tx.matches(F.col("answer"), clause)).alias("clause")).join(
        equivalents.select("clause").distinct(), "clause", "left_semi").groupBy("answer_id").agg(F.count("*").alias("eq"))
    numbers = found_in_evidence(answers, evidence, tx.matches(F.col("answer"), r"\d+(?:\.\d+)?")).select(
        "answer_id", F.col("items").alias("numbers"), F.col("found").alias("numbers_found"))
    terms = known_terms(answers, terminology, term).select("answer_id", "terms", "known")
    rows = answers.select("answer_id", F.length("answer").alias("size"))
    for side in (chars, clauses, eq, numbers, terms, graph.select("answer_id", "nodes")):
        rows = rows.join(side, "answer_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    has = zero("rows") > 0
    rows = rows.withColumns(
        {
            "citation_coverage": F.least(tx.ratio(zero("chars"), F.col("size")), F.lit(1.0)),
            "clause_precision": F.when(has, tx.ratio(zero("clauses_found"), zero("clauses"), 0.5)).otherwise(0.0),
            "equivalent_support": F.least(tx.ratio(zero("eq"), zero("clauses")), F.lit(1.0)),
            "graph_support": F.least(zero("nodes") / 5.0, F.lit(1.0)),
            "term_consistency": tx.ratio(zero("known"), zero("terms"), 0.5),
            "number_check": F.when(has, tx.ratio(zero("numbers_found"), zero("numbers"))).otherwise(0.0),
        }
    )
    c = F.col
    total = (c("citation_coverage") * 0.30 + c("clause_precision") * 0.20 + c("equivalent_support") * 0.15 + c("graph_support") * 0.15
             + c("term_consistency") * 0.10 + c("number_check") * 0.10)
    return rows.withColumn("confidence", total).withColumn(
        "level", tx.ladder(F.col("confidence"), [(0.8, "HIGH"), (0.6, "MEDIUM"), (0.4, "LOW")], "VERY_LOW"))


def confidence5(answers: DataFrame, evidence: DataFrame, added: DataFrame, clause: str = r"§\s*[\d.]+") -> DataFrame:
    """V9: evidence length, clause count and three enhancement flags. added(answer_id, equivalents, terms, links BOOLEAN)."""
    size = evidence.groupBy("answer_id").agg(F.avg(F.length("text")).alias("size"))
    rows = answers.join(size, "answer_id", "left").join(added, "answer_id", "left")
    flag = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)), 1.0).otherwise(0.0)
    quality = F.least(F.coalesce("size", F.lit(0.0)) / 500, F.lit(1.0))
    precision = F.least(F.regexp_count("answer", F.lit(clause)) / 3.0, F.lit(1.0))
    total = quality * 0.30 + precision * 0.25 + flag("equivalents") * 0.20 + flag("terms") * 0.15 + flag("links") * 0.10
    return rows.select("answer_id", total.alias("confidence"), tx.ladder(total, [(0.7, "HIGH"), (0.5, "MEDIUM")], "LOW").alias("level"))


def hallucination_risk(answers: DataFrame, evidence: DataFrame, terminology: DataFrame, absolute: list[str] = ABSOLUTE,
                       support_words: list[str] = ABSOLUTE_SUPPORT, speculative: list[str] = SPECULATIVE,
                       uncertain: list[str] = UNCERTAIN, term: str = TERM, number: str = UNIT_NUMBER) -> DataFrame:
    """Unsupported share, unsupported absolute claims, unknown terms, unmatched numbers, unmarked speculation."""
    answers, evidence = once(answers, evidence)
    support = statement_support(answers, evidence, 5).groupBy("answer_id").agg(
        F.count("*").alias("statements"), F.count_if(~F.col("loose")).alias("unsupported"))
    backed = evidence.groupBy("answer_id").agg(F.max(tx.contains_any(F.col("text"), support_words)).alias("backed"))
    numbers = found_in_evidence(answers, evidence, tx.matches(F.col("answer"), number, 1))
    terms = known_terms(answers, terminology, term)
    rows = answers
    for side in (support, backed, numbers, terms):
        rows = rows.join(side, "answer_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    claims = sum((F.regexp_count("answer", F.lit(p)) for p in absolute), F.lit(0))
    guess = tx.contains_any(F.col("answer"), speculative) & ~tx.contains_any(F.lower("answer"), uncertain)
    rows = rows.withColumns(
        {
            "outside": tx.ratio(zero("unsupported"), zero("statements")) * 0.4,
            "absolute": F.when(F.coalesce("backed", F.lit(False)), 0.0).otherwise(claims * 0.05),
            "unknown_terms": tx.ratio(zero("unknown"), zero("terms")) * 0.15,
            "number_mismatch": tx.ratio(zero("items") - zero("found"), zero("items")) * 0.15,
            "speculation": F.when(guess, 0.1).otherwise(0.0),
        }
    )
    total = F.col("outside") + F.col("absolute") + F.col("unknown_terms") + F.col("number_mismatch") + F.col("speculation")
    return rows.withColumn("risk", F.least(total, F.lit(1.0))).select(
        "answer_id", "outside", "absolute", "unknown_terms", "number_mismatch", "speculation", "risk")


def risk_items(answers: DataFrame, evidence: DataFrame, number: str = RISK_NUMBER, claim: str = ABSOLUTE_CLAIM,
               term: str = r"[一-鿿]{4,8}|[A-Z]{4,6}", cited: str = HAS_CITATION) -> DataFrame:
    """Typed risk items with severity, count and points; no row where a type has no finding."""
    answers, evidence = once(answers, evidence)
    outside = statement_support(answers, evidence, 5).groupBy("answer_id").agg(F.count_if(~F.col("loose")).alias("n"))
    missing = lambda items, title=False: found_in_evidence(answers, evidence, items, title).select(
        "answer_id", (F.col("items") - F.col("found")).cast("long").alias("n"))
    unknown = answers.select("answer_id", F.size(tx.matches(F.col("answer"), term)).cast("long").alias("n"))
    uncited = answers.select("answer_id", F.when((F.length("answer") > 100) & ~F.col("answer").rlike(cited), 1).otherwise(0).cast("long").alias("n"))
    # Type, severity, points, count that earns all points, longest list that is reported.
    kinds = [
        (outside, "source_outside", "high", 0.3, 5, 5), (missing(tx.matches(F.col("answer"), number, 1)), "unverified_numbers", "medium", 0.15, 3, None),
        (missing(tx.matches(F.col("answer"), claim, 1), True), "absolute_claims", "high", 0.25, 3, 5), (unknown, "unknown_terms", "low", 0.1, 5, 5),
        (uncited, "missing_citations", "medium", 0.2, 1, None),
    ]
    out = None
    for rows, name, severity, points, full, listed in kinds:
        n = F.col("n") if listed is None else F.least(F.col("n"), F.lit(listed))
        part = rows.filter("n > 0").select(
            "answer_id", F.lit(name).alias("type"), F.lit(severity).alias("severity"), n.cast("long").alias("count"),
            (F.least(n / float(full), F.lit(1.0)) * points).alias("points"))
        out = part if out is None else out.unionByName(part)
    return out


def fact_check(answers: DataFrame, evidence: DataFrame, absolute: list[str] = ("必须", "应当", "不得", "禁止", "不能"),
               section: str = r"(?i)(?:§|第|section)[\s\d.]+") -> DataFrame:
    """Per statement of ten or more characters: .5 + .1 per shared term, +.3 with section and source, -.2 absolute
    without source; flagged when unsupported or below .5."""
    s = statement_support(answers, evidence, 6).filter(F.length("statement") >= 10)
    backed = F.col("sources") > 0
    raw = (F.lit(0.5) + F.col("shared") * 0.1 + F.when(F.col("statement").rlike(section) & backed, 0.3).otherwise(0.0)
           - F.when(tx.contains_any(F.col("statement"), list(absolute)) & ~backed, 0.2).otherwise(0.0))
    return s.select("answer_id", "pos", "statement", backed.alias("supported"), tx.clip(raw, 0.0, 1.0).alias("confidence")).withColumn(
        "flagged", ~F.col("supported") | (F.col("confidence") < 0.5))


def fact_table(sections: DataFrame, materials: list[str], text: str = "text") -> DataFrame:
    """Flags of every section."""
    t = F.col(text)
    return sections.select(
        "doc", "number", "node_id", t.rlike(r"\d+").alias("has_numbers"), t.rlike(r"\d+%").alias("has_percent"),
        t.rlike(r"\d+°[CF]").alias("has_temperature"), t.rlike(r"\d+\s*(?:秒|分钟|小时)").alias("has_time"), tx.contains_any(t, materials).alias("has_material"))


def parameters(sections: DataFrame, patterns: dict[str, str] = PARAMETERS, text: str = "text") -> DataFrame:
    """One row per typed numeric parameter."""
    arrays = [_typed(name, tx.matches(F.col(text), p, 1)) for name, p in patterns.items()]
    return sections.select("node_id", F.inline(F.concat(*arrays)))


def _typed(name: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(name).alias("kind"), v.alias("value")))


def grounding_verdict(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Share of answer tokens (CJK characters, words longer than 2) found in the evidence -> verdict."""
    def tokens_of(c: str) -> Column:
        found = tx.matches(F.lower(c), rf"[{tx.CJK}]|[a-z0-9]+")
        return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 2) | w.rlike(f"^[{tx.CJK}]$")))

    mine = answers.select("answer_id", F.explode(tokens_of("answer")).alias("token"))
    theirs = evidence.select("answer_id", F.explode(tokens_of("text")).alias("token")).distinct().withColumn("hit", F.lit(1))
    share = mine.join(theirs, ["answer_id", "token"], "left").groupBy("answer_id").agg((F.count("hit") / F.count("*")).alias("overlap"))
    rows = answers.select("answer_id").join(share, "answer_id", "left").join(
        evidence.groupBy("answer_id").agg(F.count("*").alias("n")), "answer_id", "left")
    overlap = F.coalesce("overlap", F.lit(0.0))
    verdict = F.when(F.col("n").isNull(), "NOT_FOUND").otherwise(tx.ladder(overlap, [(0.6, "PASS"), (0.3, "PARTIAL")], "UNVERIFIED"))
    return rows.select("answer_id", overlap.alias("overlap"), verdict.alias("verdict"))


def safety_score(answers: DataFrame, evidence: DataFrame, markers: list[str] = SAFE_MARKERS, cited: str = SAFE_CITATION) -> DataFrame:
    """Verified statement share, x .9 without an uncertainty marker, x .85 without a citation."""
    share = statement_support(answers, evidence, 5).groupBy("answer_id").agg(F.avg(F.col("loose").cast("double")).alias("verified"))
    rows = answers.join(share, "answer_id", "left")
    score = (F.coalesce("verified", F.lit(1.0)) * F.when(tx.contains_any(F.col("answer"), markers), 1.0).otherwise(0.9)
             * F.when(F.col("answer").rlike(cited), 1.0).otherwise(0.85))
    return rows.select("answer_id", F.coalesce("verified", F.lit(1.0)).alias("verified"), score.alias("safety"))


def usability(answers: DataFrame, evidence: DataFrame, flags: DataFrame) -> DataFrame:
    """Metadata .30, length .25, graph .20, links .15, terms .10. flags(answer_id, graph, links, terms DOUBLE)."""
    filled = lambda c: F.when(F.length(F.coalesce(F.col(c), F.lit(""))) > 0, 1).otherwise(0)
    per = evidence.groupBy("answer_id").agg(
        (F.sum(filled("source") + filled("section") + filled("title")) / (F.count("*") * 3)).alias("metadata"),
        F.least(F.avg(F.length("text")) / 500, F.lit(1.0)).alias("length"))
    rows = answers.select("answer_id").join(per, "answer_id", "left").join(flags, "answer_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    total = zero("metadata") * 0.30 + zero("length") * 0.25 + zero("graph") * 0.20 + zero("links") * 0.15 + zero("terms") * 0.10
    score = F.when(F.col("metadata").isNull(), 0.0).otherwise(total)
    return rows.select("answer_id", score.alias("usability"), tx.ladder(score, [(0.8, "EXCELLENT"), (0.6, "GOOD"), (0.4, "FAIR")], "POOR").alias("level"))


def overall_quality(scores: DataFrame) -> DataFrame:
    """(.4 confidence + .3 (1 - risk) + .3 usability) x 100 with a grade. scores(answer_id, confidence, risk, usability)."""
    q = (F.col("confidence") * 0.4 + (1 - F.col("risk")) * 0.3 + F.col("usability") * 0.3) * 100
    return scores.select("answer_id", q.alias("quality"), tx.ladder(q, [(80, "A"), (70, "B"), (60, "C"), (50, "D")], "F").alias("grade"))
