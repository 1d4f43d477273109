"""Mappings between documents.

sections(doc, node_id, number, title, text), groups(group, doc). A mapping is a (group, number) found in two or
more records; its members stay rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.functions import text as tx
from clausemill.functions.scale import checked_join, salted_join, stored, top_per

KEY = ["group", "number"]


def map_by_number(sections: DataFrame, groups: DataFrame, at_least: int = 2) -> DataFrame:
    """M1: members of every mapping with its record and document counts."""
    rows = sections.join(groups, "doc")
    per_doc = rows.groupBy(*KEY, "doc").agg(F.count("*").alias("n"))
    sizes = per_doc.groupBy(*KEY).agg(F.sum("n").alias("records"), F.count("*").alias("documents")).filter(F.col("records") >= at_least)
    return salted_join(rows, sizes, KEY, spread="node_id")


def map_scored(members: DataFrame, requirement: list[str], word: str = r"\S+") -> DataFrame:
    """M2: 10 + max(0, 10 - var(length)/100) + 2 per word common to all members + 5 if all have requirements, at most 100.

    Common words are counted (a word in as many members as the mapping has), so members are never collected.
    """
    words = members.select(*KEY, "node_id", F.explode(F.array_distinct(tx.matches(F.lower("text"), word))).alias("w"))
    common = words.groupBy(*KEY, "w").agg(F.count("*").alias("c"))
    stats = members.groupBy(*KEY).agg(
        F.max("records").alias("records"), F.max("documents").alias("documents"), F.var_pop(F.length("text")).alias("variance"),
        F.min(tx.contains_any(F.col("text"), requirement)).alias("all_required"),
    )
    shared = salted_join(common, stats.select(*KEY, "records"), KEY, spread="w").filter("c = records").groupBy(*KEY).agg(F.count("*").alias("common_words"))
    rows = stats.join(shared, KEY, "left").fillna(0, ["common_words"])
    score = (F.lit(10.0) + F.greatest(F.lit(0.0), 10 - F.col("variance") / 100) + F.col("common_words") * 2 + F.when(F.col("all_required"), 5.0).otherwise(0.0))
    return rows.withColumn("score", F.least(score, F.lit(100.0)))


def level_of(score: Column) -> Column:
    return tx.ladder(score, [(80, "high"), (60, "medium"), (40, "low")], "minimal")


def similarity_to_first(members: DataFrame, word: str = r"\S{3,}") -> DataFrame:
    """M3: Jaccard of the word sets (x 100) of every member with the mapping's first member, and its level."""
    sets = members.select(*KEY, "node_id", F.array_distinct(tx.matches(F.lower("text"), word)).alias("words"))
    first = sets.groupBy(*KEY).agg(F.min_by(F.struct("node_id", "words"), "node_id").alias("f"))
    pairs = salted_join(sets, first, KEY, spread="node_id").filter(F.col("f.node_id") != F.col("node_id"))
    both = F.size(F.array_intersect("words", "f.words"))
    union = F.size("words") + F.size("f.words") - both
    sim = tx.ratio(both, union) * 100
    return pairs.select(*KEY, F.col("f.node_id").alias("first"), "node_id", sim.alias("similarity"), level_of(sim).alias("level"))


FEW = 32  # members of a mapping that are compared pair by pair


def similar_pairs(members: DataFrame, word: str = r"\S{3,}", least: float = 40) -> DataFrame:
    """M3: all pairs of a mapping whose word sets have a Jaccard similarity (x 100) of `least` or more, with their level.

    Word sets stay arrays, gathered by mapping. The members of a mapping of up to FEW are compared with each other; larger ones
    go through a prefix filter: with words in one order, rarest first, a pair that reaches the level shares a word among the first
    n - ceil(least n) + 1 of both sets. Only pairs that share such a word are compared, and none is missed.
    """
    words = members.select(*KEY, "node_id", F.array_distinct(tx.matches(F.lower("text"), word)).alias("ws")).filter("size(ws) > 0")
    sets = words.groupBy(*KEY, "node_id").agg(F.flatten(F.collect_list("ws")).alias("words"))
    sets = stored(sets, "mapping-sets")
    sizes = stored(sets.groupBy(*KEY).agg(F.count("*").alias("n")), "mapping-sizes")

    def renamed(rows: DataFrame) -> DataFrame:
        return rows.select(*KEY, F.col("node_id").alias("other"), F.col("words").alias("o_words"))

    few = checked_join(sets, sizes.filter(F.col("n").between(2, FEW)).select(*KEY), KEY, spread="node_id")
    both = few.join(renamed(few), KEY).filter("node_id < other")
    if not sizes.filter(F.col("n") > FEW).isEmpty():
        many = stored(checked_join(sets, sizes.filter(F.col("n") > FEW).select(*KEY), KEY, spread="node_id"), "large-mappings")
        rows = many.select(*KEY, "node_id", F.explode("words").alias("w"))
        spread = rows.groupBy("w").agg(F.count("*").alias("df"))
        ranked = rows.join(spread, "w").groupBy(*KEY, "node_id").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("ws"))
        head = F.slice(F.transform("ws", lambda x: x["w"]), F.lit(1), (F.size("ws") - F.ceil(F.size("ws") * (least / 100)) + 1).cast("int"))
        heads = ranked.select(*KEY, "node_id", F.explode(head).alias("w"))
        near = heads.join(heads.withColumnRenamed("node_id", "other"), [*KEY, "w"]).filter("node_id < other").select(*KEY, "node_id", "other").distinct()
        both = both.unionByName(near.join(many, [*KEY, "node_id"]).join(renamed(many), [*KEY, "other"]))
    common = F.size(F.array_intersect("words", "o_words"))
    sim = tx.ratio(common, F.size("words") + F.size("o_words") - common) * 100
    return both.select(*KEY, "node_id", "other", sim.alias("similarity")).filter(F.col("similarity") >= least).withColumn("level", level_of(F.col("similarity")))


def equivalents(members: DataFrame, wanted: DataFrame) -> DataFrame:
    """M4: members of the same mapping in other documents for the wanted (group, number, doc) rows."""
    asked = wanted.select(*KEY, F.col("doc").alias("w_doc")).distinct()
    return salted_join(members, asked, KEY, spread="node_id").filter(F.col("doc") != F.col("w_doc")).select(
        "group", "w_doc", "number", F.col("doc").alias("other_doc"), F.col("node_id").alias("other"))


def mapping_table(members: DataFrame) -> DataFrame:
    """M5: one row per mapping, with the first section of every document in it (a map from document to section)."""
    first = members.groupBy(*KEY, "doc").agg(F.min("node_id").alias("node_id"))
    return first.groupBy(*KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("doc", "node_id")))).alias("sections"))


def mapping_coverage(sections: DataFrame, members: DataFrame, expected: DataFrame) -> DataFrame:
    """M6: per expected document the distinct sections, the mapped ones and their share. expected(doc)."""
    total = sections.groupBy("doc").agg(F.countDistinct("number").alias("sections"))
    mapped = members.groupBy("doc").agg(F.countDistinct("number").alias("mapped"))
    rows = expected.join(total, "doc", "left").join(mapped, "doc", "left").fillna(0, ["sections", "mapped"])
    return rows.withColumns({"available": F.col("sections") > 0, "coverage": tx.ratio(F.col("mapped"), F.col("sections"))})


def coverage_gaps(members: DataFrame, expected: DataFrame) -> DataFrame:
    """M7: expected documents of a group that have no mapping. expected(group, doc)."""
    return expected.join(members.select("group", "doc").distinct(), ["group", "doc"], "left_anti")


def high_quality_share(scored: DataFrame, above: float = 50) -> DataFrame:
    """M7: high-quality mappings against all, per group."""
    return scored.groupBy("group").agg(F.count("*").alias("mappings"), F.count_if(F.col("score") > above).alias("high_quality"))


def mapping_quality(scored: DataFrame, weighted_mean: bool = False) -> DataFrame:
    """M8: mean score per group, weight 1.5 where all members have requirements; the divisor is the count, or the sum
    of the weights with `weighted_mean`."""
    w = F.when(F.col("all_required"), 1.5).otherwise(1.0)
    mean = F.sum(F.col("score") * w) / (F.sum(w) if weighted_mean else F.count("*"))
    return scored.groupBy("group").agg(F.count("*").alias("mappings"), mean.alias("quality")).withColumn("rating", level_of(F.col("quality")))


def requirement_diff(members: DataFrame, requirement: list[str], end: str = "[。.]") -> DataFrame:
    """M9: title, length and first three requirement sentences (cut at 100) per member."""
    key = F.filter(F.transform(F.split("text", end), tx.strip), lambda s: tx.contains_any(s, requirement))
    return members.select(*KEY, "doc", "node_id", "title", F.length("text").cast("long").alias("length"),
                          F.transform(F.slice(key, 1, 3), lambda s: F.substring(s, 1, 100)).alias("requirements"))


def term_diff(sections: DataFrame, agency: str, word: str, text: str = "text") -> DataFrame:
    """Terms with the number of agencies that use them: common = all of them, unique = exactly one."""
    per = sections.select(F.col(agency).alias("agency"), F.explode(F.array_distinct(tx.matches(F.col(text), word))).alias("term")).groupBy(
        "term", "agency").agg(F.count("*").alias("n"))
    total = sections.agg(F.countDistinct(agency).alias("t")).scalar()
    rows = per.groupBy("term").agg(F.count("*").alias("agencies"), F.sum("n").alias("n"), F.min("agency").alias("agency"))
    kind = F.when(F.col("agencies") == total, "common").when(F.col("agencies") == 1, "unique").otherwise("some")
    return rows.select("term", "n", "agencies", kind.alias("kind"), F.when(kind == "unique", F.col("agency")).otherwise("").alias("agency"))


def mapping_report(scored: DataFrame, k: int = 5, good: float = 70, bad: float = 40) -> DataFrame:
    """Per group the k best mappings above `good` and the k worst below `bad`."""
    best = top_per(scored.filter(F.col("score") > good), ["group"], [F.round("score", 6).desc(), F.col("number")], k)
    worst = top_per(scored.filter(F.col("score") < bad), ["group"], [F.round("score", 6), F.col("number")], k)
    cols = ["group", "number", "score", "rank"]
    return best.select(*cols, F.lit("best").alias("list")).union(worst.select(*cols, F.lit("worst").alias("list")))


def mapping_totals(scored: DataFrame, members: DataFrame, high: float = 70, low: float = 40) -> DataFrame:
    """(metric, key, value): groups, mappings, good and weak mappings of the whole report, and mapped sections per document."""
    whole = scored.agg(F.countDistinct("group").alias("groups"), F.count("*").alias("mappings"), F.count_if(F.col("score") > high).alias("good"),
                       F.count_if(F.col("score") < low).alias("weak"))
    names = ["groups", "mappings", "good", "weak"]
    totals = whole.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.lit("").alias("key"), F.col(n).alias("value")) for n in names])))
    return totals.union(members.groupBy("doc").agg(F.count("*").alias("value")).select(F.lit("document").alias("metric"), F.col("doc").alias("key"), "value"))


def shared_term_links(sections: DataFrame, word: str, k: int = 50) -> DataFrame:
    """The k strongest links between sections of different documents that share title terms, confidence .3 per shared term.

    Exact: shared terms descending, then src, dst (src < dst). Sections with the same terms are one set. The least number of
    shared terms starts at the largest possible one and is halved until k links are known. For a level t every set is met
    through its size - t + 1 rarest terms only: two sets that share t terms share one of these, and the place of that term in
    both sets bounds what they can share. On the last level, one term, a link needs nothing but the term, so of every
    term only the first sections count (`firsts`), and a word of all titles costs no more than others.
    """
    spread = sections.select("doc", "node_id", F.array_distinct(tx.matches(F.lower("title"), word)).alias("terms")).distinct()
    rows = spread.select("doc", "node_id", F.explode("terms").alias("term"))
    ranked = rows.join(rows.groupBy("term").agg(F.count("*").alias("df")), "term")
    sets = ranked.groupBy("doc", "node_id").agg(F.array_sort(F.collect_list(F.struct("df", "term"))).alias("s"))
    sets = stored(sets.select("doc", "node_id", F.transform("s", lambda x: x["term"]).alias("terms")), "term-sets")
    kept = stored(firsts(sets, ["terms"], k), "term-set-members")
    distinct = stored(sets.groupBy("terms").agg(F.count("*").alias("n"), F.countDistinct("doc").alias("docs")).withColumn("set", F.md5(F.concat_ws("\x01", "terms"))), "distinct-sets")
    named = kept.join(distinct.select("terms", "set"), "terms")
    level = distinct.agg(F.max(F.size("terms"))).first()[0] or 1
    while True:
        if level > 1:
            found = stored(expanded(set_pairs(distinct, level), named, k), "strong-links")
        else:
            of_term = firsts(sets.select("doc", "node_id", "terms", F.explode("terms").alias("term")), ["term"], 2 * k)
            one = of_term.select("term", "doc", F.col("node_id").alias("a"), F.col("terms").alias("x"))
            other = of_term.select("term", F.col("doc").alias("doc_b"), F.col("node_id").alias("b"), F.col("terms").alias("y"))
            near = one.join(other, "term").filter("doc <> doc_b AND a < b").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.array_intersect("x", "y").alias("common"))
            weak = near.groupBy("src", "dst").agg(F.first("common").alias("common"))
            strong = expanded(set_pairs(distinct, 2), named, k)
            found = strong.unionByName(weak.join(strong.select("src", "dst"), ["src", "dst"], "left_anti"))
        if level == 1 or found.limit(k).count() == k:
            break
        level = max(1, level // 2)
    out = found.select("src", "dst", F.size("common").cast("long").alias("shared"), F.array_min("common").alias("first_term"))
    return out.withColumn("confidence", F.col("shared") * 0.3).orderBy(F.desc("shared"), "src", "dst").limit(k)


def firsts(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Rows of every group that its k first pairs of different documents (by the smaller, then the larger node) can use.

    Of every document the first k + 2 rows, of these the first 2 (k + 2): outside any one document at least k + 2 are left, and
    each of them makes a smaller pair than a row that was cut.
    """
    m = k + 2
    own = top_per(rows, [*keys, "doc"], [F.col("node_id")], m, "_d").drop("_d")
    return top_per(own, keys, [F.col("node_id")], 2 * m, "_n").drop("_n")


def set_pairs(distinct: DataFrame, level: int) -> DataFrame:
    """(set, other, common) of all pairs of term sets, a set with itself too, that share `level` terms or more. distinct(set, terms, docs)."""
    big = distinct.filter(F.size("terms") >= level)
    heads = big.select("set", F.size("terms").alias("n"), F.posexplode(F.slice("terms", F.lit(1), F.size("terms") - (level - 1))).alias("at", "term"))
    near = heads.join(heads.select("term", F.col("set").alias("other"), F.col("n").alias("m"), F.col("at").alias("to")), "term")
    near = near.filter((F.col("set") < F.col("other")) & (F.least(F.col("n") - F.col("at"), F.col("m") - F.col("to")) >= level)).select("set", "other").distinct()
    both = near.join(big.select("set", "terms"), "set").join(big.select(F.col("set").alias("other"), F.col("terms").alias("o_terms")), "other")
    pairs = both.select("set", "other", F.array_intersect("terms", "o_terms").alias("common")).filter(F.size("common") >= level)
    return pairs.unionByName(big.filter("docs > 1").select("set", F.col("set").alias("other"), F.col("terms").alias("common")))


def expanded(pairs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(src, dst, common): the k strongest links of pairs of sets. members(set, doc, node_id): a bounded number for every set."""
    left = members.select("set", F.col("doc").alias("doc_a"), F.col("node_id").alias("a"))
    right = members.select(F.col("set").alias("other"), F.col("doc").alias("doc_b"), F.col("node_id").alias("b"))
    every = pairs.join(left, "set").join(right, "other").filter("doc_a <> doc_b AND a <> b AND (set <> other OR a < b)")
    links = every.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "common").distinct()
    return links.orderBy(F.desc(F.size("common")), "src", "dst").limit(k)


def equivalence_lookup(links: DataFrame, wanted: DataFrame) -> DataFrame:
    """Other clauses of the links a wanted clause is in. links(link, clause), wanted(clause)."""
    mine = links.join(wanted, "clause", "left_semi").select("link", F.col("clause").alias("wanted"))
    return salted_join(links, mine, ["link"], spread="clause").filter("clause <> wanted").select("wanted", F.col("clause").alias("other")).distinct()


def alignment_status(sections: DataFrame, alignment: DataFrame) -> DataFrame:
    """Curated number -> number table with its status, joined to the sections. alignment(number, other_number, status)."""
    return sections.select("doc", "number", "node_id").join(alignment, "number", "left").withColumn("status", F.coalesce("status", F.lit("unmapped")))
