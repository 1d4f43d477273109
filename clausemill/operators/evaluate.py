"""Evaluation jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.functions import text as tx
from clausemill.operators.terms import enhanced_tokens, ngram_tokens


def recall_at_k(results: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """Per query, 1 if the top k hold an expected document. results(query_id, doc_id, rank), expected(query_id, doc_id)."""
    hits = results.filter(F.col("rank") <= k).join(expected, ["query_id", "doc_id"], "left_semi").select("query_id").distinct()
    return expected.select("query_id").distinct().join(hits.withColumn("hit", F.lit(1)), "query_id", "left").fillna(0, ["hit"])


def keyword_recall_at_k(results: DataFrame, keywords: DataFrame, k: int) -> DataFrame:
    """Per query, 1 if any expected keyword is in a top-k text, and the share of keywords found in any of them.

    results(query_id, rank, text), keywords(query_id, keyword). Texts are not concatenated: a keyword is found if some
    row holds it.
    """
    top = results.filter(F.col("rank") <= k).select("query_id", F.lower("text").alias("t"))
    found = keywords.join(top, "query_id", "left").groupBy("query_id", "keyword").agg(
        F.coalesce(F.bool_or(F.col("t").contains(F.lower("keyword"))), F.lit(False)).alias("f"))
    return found.groupBy("query_id").agg(F.max(F.col("f").cast("int")).alias("hit"), F.avg(F.col("f").cast("double")).alias("share"))


def source_recall_at_k(results: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """Per query, 1 if a top-k result comes from an expected source. results(query_id, rank, source), expected(query_id, source)."""
    hits = results.filter(F.col("rank") <= k).join(expected, ["query_id", "source"], "left_semi").select("query_id").distinct()
    return expected.select("query_id").distinct().join(hits.withColumn("hit", F.lit(1)), "query_id", "left").fillna(0, ["hit"])


def recall_breakdown(hits: DataFrame, dims: list[str]) -> DataFrame:
    """Mean of `hit` by every prefix of the dimensions, '*' for all."""
    return hits.rollup(*dims).agg(F.count("*").alias("n"), F.avg("hit").alias("recall")).fillna("*", dims)


def intent_accuracy(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Accuracy per expected class and over all ('*'). predicted(id, intent), gold(id, expected)."""
    rows = gold.join(predicted, "id", "left").withColumn("ok", F.coalesce(F.col("intent") == F.col("expected"), F.lit(False)))
    return rows.rollup("expected").agg(F.count("*").alias("n"), F.count_if("ok").alias("correct"), F.avg(F.col("ok").cast("double")).alias("accuracy")).fillna("*", ["expected"])


def golden_summary(golden: DataFrame, k: int = 10) -> DataFrame:
    """E5: (metric, key, value): totals, counts by regulation/language/type, mean keywords, top sections and keywords."""
    one = lambda name, col: golden.agg(col.cast("double").alias("value")).select(F.lit(name).alias("metric"), F.lit("").alias("key"), "value")
    by = lambda c: golden.groupBy(F.col(c).alias("key")).agg(F.count("*").cast("double").alias("value")).select(F.lit(c).alias("metric"), "key", "value")

    def top(c: str):
        items = golden.select(F.explode(c).alias("key")).groupBy("key").agg(F.count("*").cast("double").alias("value"))
        return items.orderBy(F.desc("value"), "key").limit(k).select(F.lit("top_" + c).alias("metric"), "key", "value")

    out = one("total", F.count("*")).union(one("mean_keywords", F.avg(F.size("keywords"))))
    for part in (by("regulation"), by("language"), by("answer_type"), top("sections"), top("keywords")):
        out = out.union(part)
    return out


def validate_golden(golden: DataFrame, required: list[str], languages: list[str], regulations: list[str], at_least: int) -> DataFrame:
    """Error rows (rule, id): duplicates, blanks, unknown language, missing fields, missing coverage, too few."""
    bad = lambda rule, cond: golden.filter(cond).select(F.lit(rule).alias("rule"), F.col("id").cast("string").alias("id"))
    out = golden.groupBy("id").count().filter("count > 1").select(F.lit("duplicate").alias("rule"), F.col("id").cast("string"))
    out = out.union(bad("blank_query", F.length(F.trim(F.coalesce("query", F.lit("")))) == 0))
    out = out.union(bad("language", F.col("language").isNull() | ~F.col("language").isin(languages)))
    for c in required:
        out = out.union(bad("missing_" + c, F.col(c).isNull() | (F.col(c).cast("string") == "")))
    wanted = golden.sparkSession.createDataFrame([(r,) for r in regulations], "regulation string")
    out = out.union(wanted.join(golden.select("regulation").distinct(), "regulation", "left_anti").select(F.lit("coverage"), "regulation"))
    return out.union(golden.agg(F.count("*").alias("n")).filter(F.col("n") < at_least).select(F.lit("minimum"), F.col("n").cast("string")))


def retrieval_scorecard(queries: DataFrame, results: DataFrame, words: list[str], per_query: int = 3) -> DataFrame:
    """Per scenario accuracy, completeness, hallucination, usability, confidence and an overall label.

    queries(scenario, query_id), results(query_id, score, title, text, source_ok, section, chapter, page, document_id,
    version). A result with neither title nor text word counts as possible hallucination; a text below 20 is thin.
    """
    filled = lambda c: F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))) > 0
    related = tx.contains_any(F.lower("title"), words) | tx.contains_any(F.col("text"), words)
    thin = (F.length("text") > 0) & (F.length("text") < 20)
    grade = F.when(~related, 0.0).when(thin, 0.5).otherwise(1.0)
    rows = results.select(
        "query_id", grade.alias("grade"), (~related).alias("unrelated"), thin.alias("thin"),
        F.least(F.col("score") / 20 * 30, F.lit(30.0)).alias("quality"), F.least(F.col("score") * 0.3, F.lit(30.0)).alias("relevance"),
        (F.when(filled("section") & filled("chapter"), 30).otherwise(0) + F.when(filled("page"), 30).otherwise(0)
         + F.when(filled("document_id") & filled("version"), 20).otherwise(0) + F.when(F.col("score") >= 20, 20).otherwise(0)).alias("use"),
        F.when(F.length("text") > 100, 30.0).otherwise(0.0).alias("detail"),
    )
    per = queries.join(rows, "query_id", "left")
    s = per.groupBy("scenario").agg(
        F.countDistinct("query_id").alias("queries"), F.countDistinct(F.when(F.col("grade").isNotNull(), F.col("query_id"))).alias("answered"),
        F.count("grade").alias("results"), F.avg("grade").alias("grade"), F.avg("quality").alias("quality"), F.avg("relevance").alias("relevance"),
        F.avg("use").alias("use"), F.avg("detail").alias("detail"), F.max("unrelated").alias("unrelated"), F.max("thin").alias("thin"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    share = F.col("answered") / F.col("queries")
    near = lambda c: F.round(c + 1e-9, 1)
    out = s.select(
        "scenario", (zero("grade") * 100).alias("accuracy"),
        near(F.least(share * 40 + F.least(F.col("results") / (F.col("queries") * per_query) * 30, F.lit(30.0)) + zero("quality"), F.lit(100.0))).alias("completeness"),
        F.when(F.coalesce("unrelated", F.lit(False)), 0.8).when(F.coalesce("thin", F.lit(False)), 0.3).otherwise(0.0).alias("hallucination"),
        near(F.least(zero("use"), F.lit(100.0))).alias("usability"),
        near(F.least(share * 40 + zero("detail") + zero("relevance"), F.lit(100.0))).alias("confidence"),
    )
    mean = (F.col("accuracy") + F.col("completeness") + (100 - F.col("hallucination") * 100) + F.col("usability")) / 4
    return out.withColumn("overall", tx.ladder(mean, [(80, "excellent"), (70, "good"), (60, "fair")], "poor"))


def keyword_pass_rate(answers: DataFrame, expected: DataFrame, share: float = 0.5) -> DataFrame:
    """An answer passes with at least half of its keywords; rate per category. expected(answer_id, category, keywords)."""
    rows = answers.join(expected, "answer_id")
    found = F.size(F.filter("keywords", lambda w: F.col("answer").contains(w)))
    ok = (F.size("keywords") > 0) & (found >= F.size("keywords") * share)
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.count_if(ok).alias("passed"), F.avg(ok.cast("double")).alias("rate"))


def tokenizer_compare(texts: DataFrame, stop: list[str], id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens per text of the plain and the enhanced tokeniser, reduction, and share of plain tokens kept."""
    rows = texts.select(id, ngram_tokens(F.lower(text)).alias("a"), enhanced_tokens(F.col(text), stop, ["的"], [""]).alias("b"))
    kept = F.size(F.array_intersect("a", "b"))
    return rows.select(id, F.size("a").cast("long").alias("plain"), F.size("b").cast("long").alias("enhanced"),
                       (1 - tx.ratio(F.size("b"), F.size("a"), 1.0)).alias("reduction"), tx.ratio(kept, F.size("a")).alias("kept"))


def gate(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Metric against its threshold, at least or at most. metrics(metric, value), thresholds(metric, op, threshold)."""
    rows = thresholds.join(metrics, "metric", "left")
    ok = F.when(F.col("op") == "<=", F.col("value") <= F.col("threshold")).otherwise(F.col("value") >= F.col("threshold"))
    return rows.withColumn("passed", F.coalesce(ok, F.lit(False)))


def chunk_coverage(chunks: DataFrame, dims: list[str]) -> DataFrame:
    """Chunks per value of each dimension: (dimension, key, chunks), one pass over the chunks."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("key")) for d in dims])
    return chunks.select(F.inline(pairs)).groupBy("dimension", "key").agg(F.count("*").alias("chunks"))
