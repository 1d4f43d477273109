"""Rerankers and scored searches over candidates and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.functions import text as tx
from clausemill.functions.scale import containment_join, salted_join, top_per
from clausemill.operators import rules as ru

# Words that earn an intent bonus, and the requirement words of the result scores.
INTENT_BONUS = {
    "regulatory": (["要求", "规定", "必须", "应当", "shall", "must", "require", "compliance"], 6.0),
    "method": (["步骤", "流程", "方法", "step", "procedure", "检测", "验证"], 5.0),
    "comparison": (["比较", "差异", "compare", "versus", "vs", "区别"], 5.0),
    "definition": (["定义", "概念", "包括", "definition", "means", "include"], 4.0),
    "numerical": (["最小", "最大", "极限", "minimum", "maximum", "limit"], 3.0),
}
UNIT_PATTERN = r"(?i)\d+[\.\d]*\s*(°C|MPa|kg|rpm|kN|Nm|℃|帕|兆帕)"
REQUIREMENT_WORDS = ["必须", "应当", "要求", "不得", "shall", "must"]


def query_features(queries: DataFrame, expansions: DataFrame, patterns: dict[str, list[str]] = ru.INTENT_PATTERNS) -> DataFrame:
    """One row per query with what the reranker needs: tokens, expansion terms, phrases, clause numbers, intents."""
    extra = expansions.groupBy("query_id").agg(F.collect_set(F.lower("term")).alias("expanded"))
    toks = F.filter(tx.tokens(F.col("query")), lambda w: (F.length(w) > 1) | w.rlike(f"[{tx.CJK}]"))
    base = ru.with_intents(queries, patterns=patterns).join(extra, "query_id", "left")
    base = base.withColumns({"q_tokens": toks, "q_phrases": F.slice(tx.phrases(F.col("query")), 1, 8)})
    return base.withColumns(
        {
            "q_expanded": F.array_except(F.coalesce("expanded", F.array().cast("array<string>")), "q_tokens"),
            "q_clauses": tx.matches(F.col("query"), r"\d+\.\d+"),
            "q_intent": F.map_from_arrays(F.col("intents.intent"), F.col("intents.score")),
        }
    ).drop("expanded", "intents")


def _sum(array: Column | str, points) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + points(x))


def rerank(features: DataFrame, candidates: DataFrame, k: int, weights: dict[str, float] = ru.AUTHORITY_WEIGHTS,
           bonus: dict[str, tuple[list[str], float]] = INTENT_BONUS) -> DataFrame:
    """Keyword, phrase, clause, authority and intent points; the best k positive ones per query.

    candidates(query_id, doc_id, rank, title, chapter, section, document, document_type, text); only the first
    max(3k, 12) of a query are scored, so the wide join holds a bounded number of rows per query.
    """
    first = candidates.filter(F.col("rank") <= max(3 * k, 12))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = first.join(features, "query_id").withColumns(
        {
            "hay": F.lower(F.concat_ws(" ", blank("chapter"), blank("section"), blank("document"), blank("title"), blank("text"))),
            "sec": F.lower(F.concat_ws(" ", blank("chapter"), blank("section"))),
            "head": F.lower(blank("title")),
        }
    )
    hay, sec, head, body = F.col("hay"), F.col("sec"), F.col("head"), F.lower(blank("text"))
    words = _sum("q_tokens", lambda w: F.when(hay.contains(w), F.when(F.length(w) > 1, 5.0).otherwise(3.0)).otherwise(0.0))
    syn = _sum("q_expanded", lambda w: F.when(hay.contains(w), 2.0).otherwise(0.0))
    phrase = _sum(
        "q_phrases",
        lambda p: F.when(sec.contains(p), 15.0).when(head.contains(p), 12.0).when(hay.contains(p), 6.0).otherwise(0.0),
    )
    clause = _sum(
        "q_clauses",
        lambda n: F.when(F.substring(blank("text"), 1, 200).contains(n), 10.0).when(hay.contains(n), 5.0).otherwise(0.0),
    )
    intent = F.lit(0.0)
    for name, (marks, points) in bonus.items():
        asked = F.coalesce(F.try_element_at("q_intent", F.lit(name)), F.lit(0.0)) > 0.4
        intent = intent + F.when(asked & tx.contains_any(body, marks), points).otherwise(0.0)
        if name == "numerical":
            intent = intent + F.when(asked & body.rlike(UNIT_PATTERN), 5.0).otherwise(0.0)
    place = F.when(F.exists("q_phrases", lambda p: head.contains(p)), 8.0).otherwise(0.0) + F.when(
        F.exists("q_phrases", lambda p: F.lower(F.substring(blank("text"), 1, 150)).contains(p)), 4.0).otherwise(0.0)
    in_title = F.size(F.filter("q_tokens", lambda w: head.contains(w)))
    title = F.when((F.size("q_tokens") > 0) & (in_title >= F.size("q_tokens") * 0.6), 10.0).otherwise(0.0)
    authority = ru.authority_score(F.col("document"), F.col("document_type"), F.col("chapter"), weights)
    scored = rows.withColumn("score", words + syn + phrase + clause + authority + intent + place + title).filter("score > 0")
    return top_per(scored, ["query_id"], [F.desc("score"), F.col("doc_id")], k).select("query_id", "doc_id", "score", "rank")


# How queries name documents, by digits or by any word.
DOCUMENT_REFERENCES = [r"(?i)CCAR[-\s]*(\d+)", r"(?i)FAR[-\s]*(\d+)", r"(?i)CS[-\s]*(\w+)", r"(?i)EASA[-\s]*(\w+)"]

# Searches over sections. A query and a section are compared through units (kind, unit): an equi-join on the
# unit replaces testing every section against every query.


def query_units(queries: DataFrame, term: str, chapter: str = r"([A-H])章") -> DataFrame:
    """(query_id, kind, unit) distinct: chapter letters, dotted numbers, terms (CJK pieces of 2-4, halves of 4)."""
    terms = tx.matches(F.lower("query"), term)
    halves = F.flatten(F.transform(F.filter(terms, lambda w: w.rlike(f"^[{tx.CJK}]{{4}}$")), lambda w: F.array(w.substr(1, 2), w.substr(3, 2))))
    kinds = {"chapter": F.transform(tx.matches(F.col("query"), chapter, 1), F.upper), "number": tx.matches(F.col("query"), r"\d+(?:\.\d+)?"), "term": F.concat(terms, halves)}
    packed = F.concat(*[_kind(name, v) for name, v in kinds.items()])
    return queries.select("query_id", F.inline(packed))


def _kind(name: str, values: Column) -> Column:
    return F.transform(F.array_distinct(values), lambda u: F.struct(F.lit(name).alias("kind"), u.alias("unit")))


def section_units(sections: DataFrame, term: str, body: Column, chapter: str = r"([A-H])章") -> DataFrame:
    """(node_id, kind, unit, in_title): units of title and body, each once per section, flagged if in the title."""
    title, rest = F.lower("title"), F.lower(body)

    def terms(t: Column) -> Column:
        latin = tx.matches(t, term)
        cjk = F.flatten(F.transform(tx.matches(t, f"[{tx.CJK}]+"), lambda r: tx.ngrams_between(r, 2, 4)))
        return F.array_distinct(F.when(t.rlike(f"[{tx.CJK}]"), F.concat(latin, cjk)).otherwise(latin))

    def flagged(name: str, in_title: Column, everywhere: Column) -> Column:
        return F.transform(
            F.array_distinct(F.concat(in_title, everywhere)),
            lambda u: F.struct(F.lit(name).alias("kind"), u.alias("unit"), F.array_contains(in_title, u).alias("in_title")),
        )

    prepared = sections.withColumns({"_tt": terms(title), "_bt": terms(rest), "_tn": tx.matches(title, r"\d+(?:\.\d+)?"), "_bn": tx.matches(rest, r"\d+(?:\.\d+)?")})
    letters = tx.matches(F.col("title"), chapter, 1)
    packed = F.concat(
        flagged("term", F.col("_tt"), F.col("_bt")), flagged("number", F.col("_tn"), F.col("_bn")), flagged("chapter", letters, letters)
    )
    return prepared.select("node_id", F.inline(packed))


def whole_query_hits(queries: DataFrame, sections: DataFrame, parts: dict[str, tuple[Column, float]], query: str = "query") -> DataFrame:
    """(query_id, node_id, score): points of the first part of a section that holds the whole query, upper and lower case alike.

    A query of three or more runs of characters can only be inside a text that holds its longest inner run as a run of its
    own; that run is the join key. Shorter queries meet texts on their first characters. Either way the text is then tested.
    """
    asked = queries.select("query_id", F.lower(query).alias("_q")).filter("length(_q) > 0")
    runs = F.split("_q", r"\s+")
    inner = F.slice(runs, F.lit(2), F.greatest(F.size(runs) - 2, F.lit(0)))
    keyed = asked.withColumn("_key", F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    texts = sections.select("node_id", *[F.lower(c).alias(f"_p{i}") for i, (c, _) in enumerate(parts.values())])
    names = [f"_p{i}" for i in range(len(parts))]
    posts = texts.select("node_id", F.explode(F.array_distinct(F.flatten(F.array(*[F.split(c, r"\s+") for c in names])))).alias("_key"))
    long = salted_join(posts, keyed.filter("_key is not null"), ["_key"], spread="node_id").select("query_id", "node_id", "_q").join(texts, "node_id")
    short = keyed.filter("_key is null").select("query_id", "_q")
    found = long.select("query_id", "node_id", "_q", *names)
    for c in names:
        found = found.unionByName(containment_join(texts, c, short, "_q").select("query_id", "node_id", "_q", *names))
    points = F.coalesce(*[F.when(F.col(c).contains(F.col("_q")), p) for c, (_, p) in zip(names, parts.values())])
    return found.select("query_id", "node_id", points.alias("score")).filter("score is not null").distinct()


def _best(scored: list[DataFrame], k: int) -> DataFrame:
    every = scored[0].select("query_id", "node_id", "score")
    for s in scored[1:]:
        every = every.unionByName(s.select("query_id", "node_id", "score"))
    total = every.groupBy("query_id", "node_id").agg(F.sum("score").alias("score"))
    return top_per(total, ["query_id"], [F.desc("score"), F.col("node_id")], k).select("query_id", "node_id", "score", "rank")


def tree_search(queries: DataFrame, sections: DataFrame, k: int, term: str = rf"[{tx.CJK}]{{2,4}}") -> DataFrame:
    """Chapter letter 20, number 30, term 10 in the title else 5, whole query contained 15; top k per query."""
    q = query_units(queries, term)
    body = F.concat_ws(" ", "summary", "text")
    s = section_units(sections, term, body)
    points = F.when(F.col("kind") == "chapter", 20.0).when(F.col("kind") == "number", 30.0).when(F.col("in_title"), 10.0).otherwise(5.0)
    scored = salted_join(s, q, ["kind", "unit"], spread="node_id").groupBy("query_id", "node_id").agg(F.sum(points).alias("score"))
    return _best([scored, whole_query_hits(queries, sections, {"all": (F.concat_ws(" ", "title", body), 15.0)})], k)


def context_search(queries: DataFrame, sections: DataFrame, synonyms: DataFrame, k: int, term: str,
                   preferred: list[str] = (), section_mark: str = "条|§|25\\.", doc_refs: list[str] = DOCUMENT_REFERENCES) -> DataFrame:
    """Document reference 50, section reference 60 (each once), term 15 in the title else 8 in the summary,
    the first three expansion terms 5 in the title, raw query 20, the query's `normalised` form (where that column is given)
    10 in the title else 5 in the summary, then x1.2 preferred document, x1.1 section title.

    A document reference counts where the document's name holds it, so `CS-src1` asks for src1 and src12.
    """
    refs = F.array_distinct(F.concat(*[tx.matches(F.col("query"), p, 1) for p in doc_refs]))
    asked = queries.select("query_id", F.explode(refs).alias("ref")).filter("length(ref) > 0")
    named = containment_join(sections.select("doc").distinct(), "doc", asked, "ref").select("query_id", "doc").distinct()
    docs = salted_join(sections.select("node_id", "doc"), named, ["doc"], spread="node_id").select("query_id", "node_id", F.lit(50.0).alias("score"))
    base = query_units(queries, term).filter("kind <> 'chapter'")
    terms = base.filter("kind = 'term'").select("query_id", F.col("unit").alias("term"))
    spoken = synonyms.join(terms, "term").select("query_id", F.col("synonym").alias("unit"), "ordinal").join(
        terms.withColumnRenamed("term", "unit"), ["query_id", "unit"], "left_anti")
    distinct = spoken.groupBy("query_id", "unit").agg(F.min("ordinal").alias("ordinal"))
    extra = top_per(distinct, ["query_id"], [F.col("ordinal"), F.col("unit")], 3).select("query_id", F.lit("expansion").alias("kind"), "unit")
    units = base.unionByName(extra)
    s = section_units(sections, term, F.col("summary")).filter("kind <> 'chapter'")
    titles = s.filter("kind = 'term' and in_title").withColumn("kind", F.lit("expansion"))
    everywhere = s.filter("kind = 'term' or in_title").unionByName(titles)
    kind = F.col("kind")
    per = salted_join(everywhere, units, ["kind", "unit"], spread="node_id").groupBy("query_id", "node_id").agg(
        (F.max(F.when(kind == "number", 60.0).otherwise(0.0))
         + F.sum(F.when(kind == "term", F.when(F.col("in_title"), 15.0).otherwise(8.0)).when(kind == "expansion", 5.0).otherwise(0.0))).alias("score")
    )
    title, body = F.col("title"), F.concat_ws(" ", "summary", "text")
    every = per.select("query_id", "node_id", "score").unionByName(docs).unionByName(whole_query_hits(queries, sections, {"title": (title, 20.0), "body": (body, 20.0)}))
    if "normalised" in queries.columns:
        every = every.unionByName(whole_query_hits(queries, sections, {"title": (title, 10.0), "summary": (F.col("summary"), 5.0)}, "normalised"))
    both = every.groupBy("query_id", "node_id").agg(F.sum("score").alias("score"))
    likes = F.lit(False)
    for p in preferred:
        likes = likes | F.col("doc").contains(p)
    total = both.join(sections.select("node_id", "doc", "title"), "node_id").withColumn(
        "score", F.col("score") * F.when(likes, 1.2).otherwise(1.0) * F.when(F.lower("title").rlike(section_mark), 1.1).otherwise(1.0))
    return top_per(total.filter("score > 0"), ["query_id"], [F.round("score", 6).desc(), F.col("node_id")], k).select("query_id", "node_id", "score", "rank")


def cross_references(results: DataFrame, query_terms: DataFrame, sections: DataFrame, term: str, n: int = 3) -> DataFrame:
    """For every result the first n sections of other documents that share a query term in title or summary.

    Per term only the first n sections of each document, and of these the first 2n, can ever be chosen for a
    result, so the postings are cut to 2n rows per term before the join without losing a reference.
    results(query_id, node_id, doc), query_terms(query_id, term).
    """
    words = F.array_distinct(tx.matches(F.lower(F.concat_ws(" ", "title", "summary")), term))
    posts = sections.select("doc", F.col("node_id").alias("ref"), "ordinal", F.explode(words).alias("term")).join(
        query_terms.select("term").distinct(), "term", "left_semi")
    per_doc = top_per(posts, ["term", "doc"], [F.col("ordinal")], n, "_r")
    short = top_per(per_doc, ["term"], [F.col("ordinal")], 2 * n, "_r").drop("_r")
    pairs = results.join(query_terms, "query_id").join(short.withColumnRenamed("doc", "ref_doc"), "term").filter("ref_doc <> doc")
    once = pairs.groupBy("query_id", "node_id", "ref").agg(F.min("ordinal").alias("ordinal"), F.min("term").alias("term"))
    return top_per(once, ["query_id", "node_id"], [F.col("ordinal")], n).select("query_id", "node_id", "ref", "term", "rank")


def related_sections(scores: DataFrame, k: int) -> DataFrame:
    """Best k documents for a section used as query, without itself. scores(query_id, doc_id, score)."""
    return top_per(scores.filter("query_id <> doc_id"), ["query_id"], [F.round("score", 6).desc(), F.col("doc_id")], k)


def enhance_scores(queries: DataFrame, results: DataFrame, requirement_word: str = "要求", requirement: list[str] = REQUIREMENT_WORDS) -> DataFrame:
    """0.5 x base + 0.5 x (30 x matched share + title 20/15 + length 20/10 - repeats + requirement 15), at most 100.

    results(query_id, doc_id, title, text, source, base); a query's results are few, so the two counts use windows.
    """
    from pyspark.sql import Window

    terms = F.concat(
        tx.matches(F.col("query"), r"(?i)CCAR[-\s]*\d+"), tx.matches(F.col("query"), r"(?i)(?:§|第|section)\s*([\d.]+)", 1),
        tx.matches(F.col("query"), rf"[{tx.CJK}]{{2,4}}"), tx.matches(F.col("query"), r"[a-zA-Z]{2,}"),
    )
    q = queries.withColumns({"_terms": terms, "_cjk": tx.matches(F.col("query"), rf"[{tx.CJK}]{{2,4}}"), "_latin": tx.matches(F.col("query"), r"[a-zA-Z]{2,}")})
    same = F.count("*").over(Window.partitionBy("query_id", "source"))
    total = F.count("*").over(Window.partitionBy("query_id"))
    rows = results.join(q, "query_id").withColumns({"_same": same, "_n": total, "_low": F.lower("text")})
    hit = F.size(F.array_distinct(F.filter("_terms", lambda w: F.col("_low").contains(F.lower(w)))))
    share = tx.ratio(hit, F.size("_terms"))
    title = F.when(F.exists("_cjk", lambda w: F.col("title").contains(w)), 20.0).when(
        F.exists("_latin", lambda w: F.col("title").contains(w)), 15.0).otherwise(0.0)
    length = F.when(F.length("text") > 200, 20.0).when(F.length("text") > 100, 10.0).otherwise(0.0)
    repeats = F.when(F.col("_same") > 1, (F.col("_same") - 1) * 15.0 / F.col("_n")).otherwise(0.0)
    needs = F.when(F.col("query").contains(requirement_word) & tx.contains_any(F.col("text"), requirement), 15.0).otherwise(0.0)
    parts = rows.withColumns({"keyword_match": share, "title_points": title, "length_points": length, "repeat_points": repeats, "requirement_points": needs})
    total_points = F.col("keyword_match") * 30 + F.col("title_points") + F.col("length_points") - F.col("repeat_points") + F.col("requirement_points")
    return parts.withColumn("enhanced", F.least(F.col("base") * 0.5 + total_points * 0.5, F.lit(100.0))).drop(
        "_terms", "_cjk", "_latin", "_same", "_n", "_low")


def merge_rerank(queries: DataFrame, sets: list[DataFrame], k: int, **options) -> DataFrame:
    """Union of result sets, first per (query, title) in set order, then R14, top k."""
    tagged = [s.withColumn("_set", F.lit(i)) for i, s in enumerate(sets)]
    every = tagged[0]
    for s in tagged[1:]:
        every = every.unionByName(s)
    rest = [c for c in every.columns if c not in ("query_id", "title", "_set")]
    first = every.groupBy("query_id", "title").agg(F.min_by(F.struct(*rest), F.struct("_set", "doc_id")).alias("r")).select("query_id", "title", "r.*")
    return top_per(enhance_scores(queries, first, **options), ["query_id"], [F.round("enhanced", 6).desc(), F.col("doc_id")], k)


def merge_subqueries(found: DataFrame, k: int, factor: int = 2) -> DataFrame:
    """Results of the sub-queries of a query, best rank per document, cut at factor x k.

    found(query_id, sub, doc_id, rank)
    """
    best = found.groupBy("query_id", "doc_id").agg(F.min(F.struct("rank", "sub")).alias("b")).select("query_id", "doc_id", "b.*")
    return top_per(best, ["query_id"], [F.col("rank"), F.col("sub"), F.col("doc_id")], factor * k, "position")


def graph_first(found: DataFrame, expanded: DataFrame, k: int) -> DataFrame:
    """R16, graph first: the first 2k results of a query if there are k or more, else those of its expanded search.

    found and expanded: (query_id, doc_id, rank). `strategy` tells which one a query's rows come from; position counts from 1.
    """
    own = found.filter(F.col("rank") <= 2 * k)
    enough = own.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select("query_id")
    first = own.join(enough, "query_id", "left_semi").select("query_id", "doc_id", "rank", F.lit("graph_first").alias("strategy"))
    rest = expanded.join(enough, "query_id", "left_anti").select("query_id", "doc_id", "rank", F.lit("expanded").alias("strategy"))
    return top_per(first.unionByName(rest), ["query_id"], [F.col("rank"), F.col("doc_id")], 2 * k, "position").drop("rank")


def source_units(queries: DataFrame, separators: list[str], most: int = 4, phrase: str = r"[\u4e00-\u9fff]{2,}|[a-zA-Z]{2,}") -> DataFrame:
    """R16, multi-source: (query_id, sub, text): the query, then its parts around the first separator it holds (longer than two
    characters), else its last two phrases; at most `most` distinct units in all. Their results go through `merge_subqueries` with factor 3."""
    query = F.col("query")
    parts = F
    for s in separators:
        parts = parts.when(query.contains(s), F.filter(F.transform(F.split(query, F.lit("\\Q" + s + "\\E")), lambda p: F.trim(p)), lambda p: F.length(p) > 2))
    phrases = tx.matches(query, phrase)
    last = F.slice(phrases, F.greatest(F.size(phrases) - 1, F.lit(1)), F.lit(2))
    units = F.slice(F.array_distinct(F.concat(F.array(query), parts.otherwise(last))), 1, most)
    return queries.filter(F.coalesce(F.trim("query"), F.lit("")) != "").select("query_id", F.posexplode(units).alias("sub", "text"))


def relevance_grade(results: DataFrame) -> DataFrame:
    """Quality of a query's results from their relevance, and whether to refine. results(query_id, relevance)."""
    g = results.groupBy("query_id").agg(F.count("*").alias("n"), F.max("relevance").alias("best"), F.avg("relevance").alias("mean"))
    best, mean = F.col("best"), F.col("mean")
    raw = F.when(best >= 0.5, 0.5 + 0.3 * mean + 0.2 * best).when(best >= 0.3, 0.4 + 0.3 * mean + 0.2 * best).otherwise(0.3 + 0.4 * mean)
    quality = F.when(best.isNull(), 0.65).otherwise(tx.clip(raw, 0.3, 0.95))
    return g.withColumns({"quality": quality, "refine": F.coalesce((best < 0.15) & (mean < 0.1), F.lit(False))})


def query_clause_map(sections: DataFrame, pattern: str = rf"[{tx.CJK}]{{2,}}") -> DataFrame:
    """Keyword -> clauses with the keyword in their title, one row per pair plus the keyword's clause count."""
    pairs = sections.select(F.explode(F.array_distinct(tx.matches(F.col("title"), pattern))).alias("keyword"), "doc", "number").distinct()
    return salted_join(pairs, pairs.groupBy("keyword").agg(F.count("*").alias("clauses")), ["keyword"], spread="number")


def citations(results: DataFrame, minimum: int = 500, breaks: str = "。") -> DataFrame:
    """Snippet cut at the last sentence or line end beyond half of the minimum, whole if 100 longer at most.

    results(query_id, rank, source, section, text).
    """
    cut = F.substring("text", 1, minimum)
    last = lambda mark: F.length(cut) - F.length(F.substring_index(cut, mark, -1))
    point = F.greatest(last(breaks), last("\n"))
    snippet = F.when(F.length("text") <= minimum + 100, F.col("text")).otherwise(
        F.concat(F.when(point - 1 > minimum * 0.5, cut.substr(F.lit(1), point)).otherwise(cut), F.lit("...")))
    return results.select(
        "query_id", F.col("rank").alias("num"), F.coalesce("source", F.lit("Unknown source")).alias("source"),
        F.coalesce("section", F.lit("未知条款")).alias("section"), snippet.alias("snippet"),
        F.substring(F.split("text", "\n")[0], 1, 150).alias("highlight"),
    )


def match_catalog(sources: DataFrame, catalog: DataFrame, strip: str = r"^(?i)(doc_|src_)|[-_]?r\d+$") -> DataFrame:
    """Catalogue entry of a source name: exact id, then an id contained in the name, then the stripped name.

    Names are short, so their substrings of catalogue-id lengths are exploded and all stages are equi-joins.
    sources(source), catalog(id, title).
    """
    name = F.lower("source")
    plain = F.regexp_replace(name, strip, "")
    def subs(c: Column) -> Column:
        n = F.length(c)
        return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.transform(
            F.sequence(F.lit(1), F.greatest(n - i + 1, F.lit(1))), lambda w: c.substr(i, w)))))
    keys = F.concat(
        F.array(F.struct(F.lit(1).alias("stage"), name.alias("key"))),
        F.transform(subs(name), lambda s: F.struct(F.lit(2).alias("stage"), s.alias("key"))),
        F.transform(subs(plain), lambda s: F.struct(F.lit(3).alias("stage"), F.regexp_replace(s, strip, "").alias("key"))),
    )
    # Repeated keys of a source change no minimum; taking them out would hold all substrings in memory.
    wanted = sources.select("source").distinct().select("source", F.inline(keys))
    ids = catalog.select(F.col("id"), "title", F.explode(F.array(
        F.struct(F.lit(1).alias("stage"), F.lower("id").alias("key")), F.struct(F.lit(2).alias("stage"), F.lower("id").alias("key")),
        F.struct(F.lit(3).alias("stage"), F.regexp_replace(F.lower("id"), strip, "").alias("key")))).alias("e")).select("id", "title", "e.*").filter("length(key) > 0")
    hits = wanted.join(ids, ["stage", "key"])
    return hits.groupBy("source").agg(F.min(F.struct("stage", "id", "title")).alias("m")).select("source", "m.*")
