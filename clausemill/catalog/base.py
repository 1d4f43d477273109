"""Query registry and the views that Spark derives from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.functions import text as tx
from clausemill.functions.scale import deal_finely, file_bytes, spread_out, tune
from clausemill.session import ship

TEXT_TABLES = ("documents", "pages", "conversations")
QUERIES: dict[str, Callable[["Tables"], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its oracle."""

    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


class Tables:
    """Lazy access to one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = ship(tune(spark))
        self.dir = sf_dir

    def __call__(self, name: str) -> DataFrame:
        path = f"{self.dir}/{name}.parquet"
        df, size = self.spark.read.parquet(path), file_bytes(self.spark, path)
        deal_finely(self.spark, size)
        return spread_out(df, size) if name in TEXT_TABLES else df

    def rows(self, schema: str, values: list[tuple]) -> DataFrame:
        """A small literal rule table."""
        return self.spark.createDataFrame(values, schema)

    def docs(self) -> DataFrame:
        return self("documents").select("doc_id", "text")

    def scanned_docs(self) -> DataFrame:
        """`docs` for steps that pass over texts row by row and hold none of them: texts are shuffled only if fewer files than cores
        (at most 32) hold them."""
        path = f"{self.dir}/documents.parquet"
        df = self.spark.read.parquet(path).select("doc_id", "text")
        deal_finely(self.spark, file_bytes(self.spark, path))
        return df if len(df.inputFiles()) >= min(self.spark.sparkContext.defaultParallelism, 32) else self.docs()

    def questions(self) -> DataFrame:
        return self("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))

    def sections(self) -> DataFrame:
        """One section per document: first line is the title, second the summary, the rest the parts."""
        n = F.floor(F.col("doc_id") / 20).cast("long")
        lines = F.split("text", "\n")
        return (
            self("documents")
            .withColumn("_lines", lines)
            .select(
                F.col("source").alias("doc"),
                F.concat_ws(":", "source", "doc_id").alias("node_id"),
                F.col("doc_id").alias("ordinal"),
                F.concat((n % 9 + 1).cast("string"), F.lit("."), n.cast("string")).alias("number"),
                F.col("_lines")[0].alias("title"),
                F.coalesce(F.get("_lines", F.lit(1)), F.lit("")).alias("summary"),
                F.slice("_lines", 3, F.greatest(F.size("_lines") - 2, F.lit(0))).alias("content_parts"),
                "text",
                "lang",
                (n % 97).alias("page"),
            )
        )

    def answers(self) -> DataFrame:
        """User turn = query, the assistant turn right after it = answer."""
        c = self("conversations")
        user = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("query"))
        return (
            c.filter("role = 'assistant'")
            .join(user, ["conv_id", "turn"])
            .select((F.col("conv_id") * 100 + F.col("turn")).alias("answer_id"), "query", F.col("text").alias("answer"))
        )

    def evidence(self) -> DataFrame:
        """Up to three neighbouring turns of every answer: two before it and one after it."""
        c = self("conversations")
        near = F.explode(
            F.array(*[F.struct(F.lit(d).alias("shift"), F.lit(r).alias("rank")) for d, r in ((2, 1), (1, 2), (-1, 3))])
        ).alias("n")
        rows = c.select("*", near).select(
            (F.col("conv_id") * 100 + F.col("turn") + F.col("n.shift")).alias("answer_id"),
            F.col("n.rank").cast("long").alias("rank"),
            "text",
            F.concat(F.lit("src"), ((F.col("conv_id") + F.col("turn")) % 5).cast("string")).alias("source"),
            F.element_at(
                F.array(*[F.lit(a) for a in ("CAAC", "FAA", "EASA", "OTHER")]), (F.length("text") % 4 + 1).cast("int")
            ).alias("authority"),
            F.split("text", " ")[0].alias("title"),
            F.when(F.col("turn") % 3 != 0, F.concat_ws(".", F.col("turn"), F.col("n.rank"))).alias("section"),
            (F.length("text") % 10 / 10.0).alias("relevance"),
        )
        return rows.join(self.answers().select("answer_id"), "answer_id", "left_semi")

    def links(self) -> DataFrame:
        """href targets of the pages: page host -> first path part of every link."""
        return (
            self("pages")
            .select("page_id", F.explode(tx.matches(F.col("html"), r'href="/([^"]*)"', 1)).alias("target"))
            .select(F.concat(F.lit("page:"), "page_id").alias("src"), F.concat(F.lit("word:"), F.lower("target")).alias("dst"))
        )

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """Link graph: pages and link words as nodes, distinct links as edges."""
        edges = self.links().distinct().select("src", "dst", F.lit("REFERS_TO").alias("type"))
        pages = self("pages").select(
            F.concat(F.lit("page:"), "page_id").alias("id"),
            F.when(F.col("page_id") % 3 == 0, "Section").when(F.col("page_id") % 3 == 1, "Test").otherwise("Parameter").alias("type"),
            F.regexp_extract("html", r"<h1>([^<]*)</h1>", 1).alias("label"),
        )
        words = edges.select(F.col("dst").alias("id")).distinct().select(
            "id", F.lit("RotorPart").alias("type"), F.expr("substr(id, 6)").alias("label")
        )
        return pages.unionByName(words), edges


# SQL text of the same views, written for the checking engine.
TOK = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"


def tok(col: str) -> str:
    return TOK.format(col)


SECTIONS = r"""sections AS (
  SELECT source AS doc, source || ':' || doc_id AS node_id, doc_id AS ordinal,
         ((doc_id // 20) % 9 + 1) || '.' || (doc_id // 20) AS number,
         lines[1] AS title, coalesce(lines[2], '') AS summary, lines[3:] AS content_parts, text, lang,
         (doc_id // 20) % 97 AS page
  FROM (SELECT *, string_split(text, chr(10)) AS lines FROM documents))"""

ANSWERS = """answers AS (
  SELECT a.conv_id * 100 + a.turn AS answer_id, u.text AS query, a.text AS answer
  FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn
  WHERE a.role = 'assistant' AND u.role = 'user')"""

EVIDENCE = (
    ANSWERS
    + """,
evidence AS (
  SELECT c.conv_id * 100 + c.turn + n.shift AS answer_id, n.rank::BIGINT AS rank, c.text,
         'src' || ((c.conv_id + c.turn) % 5) AS source,
         (['CAAC', 'FAA', 'EASA', 'OTHER'])[(length(c.text) % 4 + 1)::INT] AS authority,
         string_split(c.text, ' ')[1] AS title,
         CASE WHEN c.turn % 3 <> 0 THEN c.turn || '.' || n.rank END AS section,
         (length(c.text) % 10) / 10.0::DOUBLE AS relevance
  FROM conversations c, (VALUES (2, 1), (1, 2), (-1, 3)) n(shift, rank)
  WHERE c.conv_id * 100 + c.turn + n.shift IN (SELECT answer_id FROM answers))"""
)

GRAPH = r"""links AS (
  SELECT 'page:' || page_id AS src, 'word:' || lower(t) AS dst
  FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS t FROM pages)),
edges AS (SELECT DISTINCT src, dst, 'REFERS_TO' AS type FROM links),
nodes AS (
  SELECT 'page:' || page_id AS id,
         CASE page_id % 3 WHEN 0 THEN 'Section' WHEN 1 THEN 'Test' ELSE 'Parameter' END AS type,
         regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS label FROM pages
  UNION ALL
  SELECT DISTINCT dst, 'RotorPart', substr(dst, 6) FROM edges)"""
