"""Corpus quality and telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.functions import text as tx
from clausemill.functions.scale import exact_percentile
from clausemill.operators.structure import AUTHORITY_RULES, authority_of

# Scores of the parse-quality labels and limits of the document gates.
PARSE_QUALITY = {"excellent": 1.0, "good": 0.85, "partial": 0.6}
GATES = {"parse": 0.7, "completeness": 0.8, "terms": 0.5, "links": 0.3, "queries": 0.6}


def completeness(sections: DataFrame, short: int = 10) -> DataFrame:
    """O1: share of sections with a short summary per document; an issue above one half."""
    flag = (F.length(F.coalesce("summary", F.lit(""))) < short).cast("double")
    return sections.groupBy("doc").agg(F.count("*").alias("sections"), F.avg(flag).alias("short_share")).withColumn("issue", F.col("short_share") > 0.5)


def validate_headers(headers: DataFrame, required: list[str]) -> DataFrame:
    """O2: documents with missing required fields and their names."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), c) for c in required]))
    return headers.withColumn("missing", missing).filter(F.size("missing") > 0)


def corpus_score(issues: DataFrame, gaps: DataFrame, invalid: DataFrame) -> DataFrame:
    """O3: 100 - 2 issues - 3 gaps - 5 invalid, clamped; three counts in one row."""
    tagged = lambda df, name: df.select(F.lit(name).alias("k"))
    rows = tagged(issues, "issues").union(tagged(gaps, "gaps")).union(tagged(invalid, "invalid"))
    c = rows.agg(*[F.count_if(F.col("k") == n).alias(n) for n in ("issues", "gaps", "invalid")])
    return c.withColumn("score", tx.clip((100 - F.col("issues") * 2 - F.col("gaps") * 3 - F.col("invalid") * 5).cast("double"), 0.0, 100.0))


def document_gates(docs: DataFrame, quality=PARSE_QUALITY, limits=GATES) -> DataFrame:
    """Five gates and a status. docs(doc, parse_quality, issues, terms, links, low_queries)."""
    table = F.create_map(*[F.lit(x) for kv in quality.items() for x in kv])
    scores = {
        "parse": F.coalesce(F.try_element_at(table, F.col("parse_quality")), F.lit(0.0)),
        "completeness": F.greatest(F.lit(0.0), 1 - F.col("issues") * 0.1),
        "terms_gate": F.least(F.col("terms") / 50.0, F.lit(1.0)),
        "links_gate": F.least(F.col("links") / 100.0, F.lit(1.0)),
        "queries": F.greatest(F.lit(0.0), 1 - F.col("low_queries") * 0.2),
    }
    out = docs.withColumns(scores)
    names = dict(zip(scores, limits.values()))
    failed = sum(((F.col(c) + 1e-9 < limit).cast("int") for c, limit in names.items()), F.lit(0))
    return out.withColumn("failed", failed).withColumn(
        "status", F.when(F.col("failed") == 0, "PASSED").when(F.col("failed") <= 2, "WARNING").otherwise("BLOCKED"))


def parse_validation(actual: DataFrame, expected: DataFrame, share: float = 0.8) -> DataFrame:
    """Found sections against 80 % of the expected. actual(doc, sections), expected(doc, expected)."""
    rows = expected.join(actual, "doc", "left").fillna(0, ["sections"])
    return rows.withColumn("valid", (F.col("sections") > 0) & (F.col("sections") >= F.col("expected") * share))


def new_documents(raw: DataFrame, processed: DataFrame) -> DataFrame:
    """Raw documents without a processed twin. Both have (stem)."""
    return raw.join(processed, "stem", "left_anti")


def latency_percentiles(events: DataFrame, key: str, value: str, bucket: Column, percents=(50, 95, 99)) -> DataFrame:
    """Element floor(n*p/100) of the sorted values per key, exact and without collecting a key's values."""
    return exact_percentile(events, [key], value, bucket, list(percents))


def confidence_shares(events: DataFrame, key: str, confidence: str) -> DataFrame:
    """Mean confidence and shares of high (.7), medium (.4) and low per key."""
    c = F.col(confidence)
    share = lambda cond: F.avg(cond.cast("double"))
    return events.groupBy(key).agg(F.count("*").alias("n"), F.avg(c).alias("mean"), share(c >= 0.7).alias("high"),
                                   share((c >= 0.4) & (c < 0.7)).alias("medium"), share(c < 0.4).alias("low"))


def source_counts(events: DataFrame, sources: str, k: int | None = 10) -> DataFrame:
    """Events per source, top k."""
    rows = events.select(F.explode(sources).alias("source")).groupBy("source").agg(F.count("*").alias("n"))
    return rows if k is None else rows.orderBy(F.desc("n"), "source").limit(k)


def authority_counts(chunks: DataFrame, column: str, rules=AUTHORITY_RULES) -> DataFrame:
    """Chunks per authority."""
    return chunks.groupBy(authority_of(F.col(column), rules).alias("authority")).agg(F.count("*").alias("chunks"))


def catalog_filter(catalog: DataFrame, layer: str | None = None, jurisdiction: str | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """Entries of a layer and jurisdiction, names compared without case and through aliases."""
    out = catalog
    if layer is not None:
        out = out.filter(F.lower("layer") == layer.lower())
    if jurisdiction is not None:
        name = (aliases or {}).get(jurisdiction.lower(), jurisdiction)
        out = out.filter(F.lower("jurisdiction") == name.lower())
    return out


def catalog_by_layer(catalog: DataFrame, layers: DataFrame) -> DataFrame:
    """Entries per layer, layers without entries included with 0. layers(layer)."""
    counts = catalog.groupBy("layer").agg(F.count("*").alias("entries"), F.min("title").alias("first_title"))
    return layers.join(counts, "layer", "left").fillna(0, ["entries"])


def corpus_totals(sections: DataFrame, mapped: DataFrame) -> DataFrame:
    """Documents, clauses, mapped clauses and the share mapped; `issue_count` gives the health label."""
    m = mapped.select("node_id").distinct().withColumn("m", F.lit(1))
    rows = sections.join(m, "node_id", "left")
    flawed = F.count_if(F.length(F.coalesce("summary", F.lit(""))) == 0)
    out = rows.agg(F.countDistinct("doc").alias("documents"), F.count("*").alias("clauses"), F.count("m").alias("mapped"), flawed.alias("issue_count"))
    health = F.when(F.col("issue_count") == 0, "healthy").when(F.col("issue_count") <= 5, "good").when(F.col("issue_count") <= 15, "fair").otherwise("poor")
    return out.withColumns({"share": tx.ratio(F.col("mapped"), F.col("clauses")), "health": health})


def domain_coverage(clauses: DataFrame, domain: str, missing: str = "unclassified") -> DataFrame:
    """Clauses and their share per domain. A clause without a domain counts as `missing`."""
    total = clauses.agg(F.count("*").alias("t")).scalar()
    per = clauses.groupBy(F.coalesce(F.col(domain), F.lit(missing)).alias("domain")).agg(F.count("*").alias("clauses"))
    return per.withColumn("share", tx.ratio(F.col("clauses"), total))


def low_score_queries(log: DataFrame, key: str, score: str, below: float) -> DataFrame:
    """Query keys whose mean score is below the limit."""
    return log.groupBy(key).agg(F.count("*").alias("n"), F.avg(score).alias("mean")).filter(F.col("mean") < below)
