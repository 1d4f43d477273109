"""Section trees in two layouts -> one flat section table (S3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.functions import text as tx
from clausemill.functions.scale import cut_lineage
from clausemill.operators.structure import stem

NODE = "node_id string, id string, number string, title string, start_index int, page int, summary string, text string, content_parts array<string>, nodes array<string>, sections array<string>"


def read_section_tree(spark: SparkSession, path: str) -> DataFrame:
    """sections(doc, node_id, parent_id, depth, ordinal, number, title, page, summary, text, content_parts).

    Layout A has `structure` as a list of nodes with `nodes`; layout B has `structure.chapters` with `sections`. A node's
    children stay JSON text until their level is reached, so any depth is read without a recursive schema; the loop
    ends at the first empty level. ordinal is the array of positions from the root, which sorts in document order.
    """
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    raw = F.get_json_object("value", "$.structure")
    layout_b = F.get_json_object("value", "$.structure.chapters")
    level = files.select(
        F.coalesce(F.get_json_object("value", "$.doc_name"), stem(F.col("_metadata.file_path"))).alias("doc"),
        F.lit(None).cast("string").alias("parent_id"), F.array().cast("array<int>").alias("path"),
        F.from_json(F.coalesce(layout_b, raw), "array<string>").alias("children"),
    )
    out, depth = None, 0
    while True:
        depth += 1
        nodes = level.select("doc", "parent_id", "path", F.posexplode("children").alias("i", "json")).withColumn("n", F.from_json("json", NODE))
        here = F.array_append("path", F.col("i"))
        rows = nodes.select(
            "doc", "parent_id", here.alias("path"), F.lit(depth).alias("depth"),
            F.coalesce("n.node_id", "n.id", F.concat_ws(":", "doc", F.array_join(here, "/"))).alias("node_id"),
            F.coalesce("n.number", tx.section_number(F.col("n.title"))).alias("number"), F.col("n.title").alias("title"),
            F.coalesce("n.page", "n.start_index").alias("page"), F.coalesce("n.summary", F.lit("")).alias("summary"),
            F.coalesce("n.text", F.lit("")).alias("text"), F.coalesce("n.content_parts", F.array().cast("array<string>")).alias("content_parts"),
            F.coalesce("n.nodes", "n.sections").alias("children"),
        )
        if depth > 1:
            rows = cut_lineage(rows)
            if rows.isEmpty():
                break
        out = rows.drop("children") if out is None else out.unionByName(rows.drop("children"))
        level = rows.filter("size(children) > 0").select("doc", F.col("node_id").alias("parent_id"), "path", "children")
    return out.withColumnRenamed("path", "ordinal")
