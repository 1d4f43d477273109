"""Extractive answers from evidence, no language model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.functions import text as tx
from clausemill.functions.scale import top_per

# Requirement words, labels and the safe-answer marker.
REQUIREMENT = ["必须", "应当", "要求", "不得", "禁止", "需要", "应"]
SAFE_MARKER = "通常情况下"


def sentences(text: Column, end: str = "[。；;]") -> Column:
    return F.transform(F.split(tx.strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), end), tx.strip)


def key_sentences(evidence: DataFrame, requirement: list[str] = REQUIREMENT, end: str = "[。；;]", at_most: int = 8) -> DataFrame:
    """A1: sentences of five or more characters with requirement words, else the first three; at most eight."""
    key = F.filter(sentences(F.col("text"), end), lambda s: (F.length(s) >= 5) & tx.contains_any(s, requirement))
    plain = F.slice(F.filter(F.slice(sentences(F.col("text"), end), 1, 3), lambda s: F.length(s) > 0), 1, 3)
    chosen = F.when(F.size(key) > 0, F.slice(key, 1, at_most)).otherwise(plain)
    return evidence.select("answer_id", "rank", F.posexplode(chosen).alias("pos", "sentence"))


def direct_answer(evidence: DataFrame, intents: DataFrame, end: str = "。") -> DataFrame:
    """A2: numerical intent -> first five numbers; else first sentence of 16-199 characters; else first 200 characters.

    Uses the best-ranked evidence row. intents(answer_id, intent).
    """
    best = evidence.groupBy("answer_id").agg(F.min_by("text", "rank").alias("text")).join(intents, "answer_id", "left")
    numbers = F.slice(tx.matches(F.col("text"), r"\d+(?:\.\d+)?%?"), 1, 5)
    fitting = F.get(F.filter(F.split("text", end), lambda s: (F.length(s) > 15) & (F.length(s) < 200)), F.lit(0))
    text = F.when((F.col("intent") == "numerical") & (F.size(numbers) > 0), F.array_join(numbers, ", ")).otherwise(
        F.coalesce(tx.strip(fitting), F.substring("text", 1, 200)))
    return best.select("answer_id", text.alias("direct"))


def evidence_digest(evidence: DataFrame, at_most: int = 5) -> DataFrame:
    """A3: numbered digest of an answer's best evidence; text cut at 300, label by relevance .8/.5.

    The digest lists the first `at_most` rows, which also bounds what is joined into one string.
    """
    top = top_per(evidence, ["answer_id"], [F.col("rank")], at_most, "num")
    label = tx.ladder(F.col("relevance"), [(0.8, "high"), (0.5, "medium")], "low")
    line = F.concat(F.col("num").cast("string"), F.lit(". ["), "source", F.lit("] ("), label, F.lit(") "), F.substring("text", 1, 300))
    packed = top.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("num", line.alias("line")))).alias("l"))
    return packed.select("answer_id", F.array_join("l.line", "\n").alias("digest"))


def overlap_snippets(queries: DataFrame, evidence: DataFrame, end: str = "。", k: int = 3, limit: float = 0.2) -> DataFrame:
    """A4: where no evidence reaches the limit: sentences above 20 characters that share a keyword, top k of the
    first three evidence rows. queries(answer_id, query)."""
    words = lambda c: F.array_distinct(tx.matches(F.lower(c), rf"[{tx.CJK}]+|[a-z]+"))
    weak = evidence.groupBy("answer_id").agg(F.max("relevance").alias("best")).filter(F.col("best") < limit)
    rows = evidence.filter("rank <= 3").join(weak, "answer_id", "left_semi").join(
        queries.select("answer_id", F.filter(words("query"), lambda w: F.length(w) >= 2).alias("keys")), "answer_id")
    parts = rows.select("answer_id", "rank", "source", "keys", F.posexplode(F.split("text", end)).alias("pos", "s")).filter(F.length("s") > 20)
    scored = parts.withColumn("overlap", F.size(F.array_intersect("keys", words("s")))).filter("overlap >= 1")
    best = top_per(scored, ["answer_id"], [F.desc("overlap"), F.col("rank"), F.col("pos")], k, "num")
    return best.select("answer_id", "num", "source", tx.strip(F.col("s")).alias("sentence"), "overlap")


def safe_summary(evidence: DataFrame, end: str = "[。.]", limit: int = 500) -> DataFrame:
    """A5: marker, title and first three sentences of the best evidence (cut at the limit), its citation and up to two
    further references."""
    top = top_per(evidence, ["answer_id"], [F.col("rank")], 3, "num")
    ref = F.concat("source", F.when(F.length(F.coalesce("section", F.lit(""))) > 0, F.concat(F.lit(" §"), "section")).otherwise(""))
    lead = F.array_join(F.slice(F.filter(sentences(F.col("text"), end), lambda s: F.length(s) > 0), 1, 3), ". ")
    core = F.substring(F.concat(F.coalesce("title", F.lit("")), F.lit(": "), lead), 1, limit)
    rows = top.select("answer_id", "num", ref.alias("ref"), core.alias("core"))
    packed = rows.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("num", "ref"))).alias("r"), F.min_by("core", "num").alias("core"))
    more = F.slice(F.col("r.ref"), 2, 2)
    return packed.select("answer_id", F.concat(
        F.lit(SAFE_MARKER + "，"), "core", F.lit(" ["), F.col("r.ref")[0], F.lit("]"),
        F.when(F.size(more) > 0, F.concat(F.lit(" | "), F.array_join(more, "; "))).otherwise("")).alias("summary"))


def term_notes(answers: DataFrame, forms: DataFrame, pattern: str, k: int = 3) -> DataFrame:
    """Terms of the answer that have an expansion, first k by position. forms(term, expansion)."""
    found = answers.select("answer_id", F.posexplode(F.array_distinct(tx.matches(F.col("answer"), pattern))).alias("pos", "term"))
    return top_per(found.join(forms, "term"), ["answer_id"], [F.col("pos"), F.col("expansion")], k, "num").select("answer_id", "num", "term", "expansion")


def missing_references(answers: DataFrame, evidence: DataFrame, equivalents: DataFrame, k: int = 5, more: int = 3) -> DataFrame:
    """Section references of the evidence that the answer does not mention (up to k), and equivalents of those
    (up to `more`). equivalents(section, other)."""
    refs = evidence.filter(F.length(F.coalesce("section", F.lit(""))) > 0).groupBy("answer_id", "section").agg(F.min("rank").alias("rank"))
    absent = refs.join(answers, "answer_id").filter(~F.col("answer").contains(F.col("section")))
    first = top_per(absent, ["answer_id"], [F.col("rank"), F.col("section")], k, "num").select("answer_id", "num", "section")
    linked = first.join(equivalents, "section").groupBy("answer_id", "other").agg(F.min("num").alias("n"))
    extra = top_per(linked, ["answer_id"], [F.col("n"), F.col("other")], more, "num").select("answer_id", "num", F.col("other").alias("section"))
    return first.withColumn("kind", F.lit("missing")).unionByName(extra.withColumn("kind", F.lit("equivalent")))
