"""URL rules by hashed host-suffix and path-prefix expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_DIGITS = 8  # hexadecimal digits of the digest that are joined on


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """`keep` columns, host, path, rule and verdict of every row of `urls`.

    `rules`: host, path, verdict. A rule fits its host and all subdomains where the path starts with the rule's path; the rule of
    most characters wins, and `block` wins over `allow` on the same rule. Without a rule the verdict is `default`.

    Only distinct (host, path) pairs are expanded, and only to suffixes of as many labels and prefixes of as many characters as
    some rule has. Expressions meet rules on a short digest prefix; full digests decide. No broadcast is forced.
    Null url or one without `://`: host and path empty, rule null, the default verdict. Repeated rows are kept. Rules with a null
    part are ignored. Empty tables work: no urls, no rows; no rules, the default. Columns not named are dropped.
    """
    rules = rules.select("host", "path", "verdict").dropna().distinct()
    shapes = rules.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars")).distinct().collect()
    pages = urls.select(*keep, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if not shapes:
        return pages.select(*keep, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    hosts = F.array_distinct(F.array(*[F.substring_index("host", ".", -n) for n in sorted({s.labels for s in shapes})]))
    heads = F.array_distinct(F.array(*[F.substring("path", 1, n) for n in sorted({s.chars for s in shapes})]))
    pairs = pages.select("host", "path").distinct()
    expressions = (
        pairs.select("host", "path", F.explode(hosts).alias("_h"), heads.alias("_heads"))
        .select("host", "path", "_h", F.explode("_heads").alias("_p"))
        .withColumn("_digest", digest(F.col("_h"), F.col("_p")))
        .select("host", "path", "_digest", F.substring("_digest", 1, PREFIX_DIGITS).alias("_prefix"))
    )
    keyed = rules.select(
        F.concat("host", "path").alias("rule"), "verdict", digest(F.col("host"), F.col("path")).alias("_full")
    ).withColumn("_prefix", F.substring("_full", 1, PREFIX_DIGITS))
    order = F.struct(F.length("rule"), F.col("verdict") == "block", F.col("rule"))
    best = (
        expressions.join(keyed, "_prefix")
        .filter(F.col("_digest") == F.col("_full"))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("rule", "verdict"), order).alias("_best"))
    )
    return pages.join(best, ["host", "path"], "left").select(
        *keep, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
