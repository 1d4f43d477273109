"""Graph files in three formats and the stored graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.operators.graph_query import degree_stats, type_counts

FILE = (
    "entities array<struct<id:string,type:string,name:string,label:string,description:string>>, nodes string, "
    "relationships array<struct<source:string,target:string,from_id:string,to_id:string,type:string,rel_type:string,relation:string,description:string>>, "
    "edges array<struct<source:string,target:string,from_id:string,to_id:string,type:string,rel_type:string,relation:string,description:string>>"
)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entity lists, id -> node maps or export lists, normalised to nodes(id, type, label, description) and
    edges(src, dst, type, description). Edges without both ends are dropped; the default type is RELATED_TO."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.from_json("value", FILE).alias("g"))
    listed = "id string, type string, label string, name string, title string, description string, text string"
    one = files.select(F.inline("g.entities")).select("id", "type", F.coalesce("name", "label").alias("label"), "description")
    mapped = files.select(F.explode(F.from_json("g.nodes", "map<string,string>")).alias("id", "j")).select("id", F.from_json("j", listed).alias("n")).select(
        "id", "n.type", F.coalesce("n.label", "n.name").alias("label"), "n.description")
    export = files.filter(F.col("g.nodes").startswith("[")).select(F.explode(F.from_json("g.nodes", f"array<struct<{listed.replace(' string', ':string')}>>")).alias("n")).select(
        "n.id", "n.type", F.coalesce("n.label", "n.title", "n.name").alias("label"), F.coalesce("n.description", "n.text").alias("description"))
    nodes = one.unionByName(mapped.filter("type is not null or label is not null")).unionByName(export).filter("id is not null")
    both = files.select(F.inline(F.concat(
        F.coalesce("g.relationships", F.array().cast("array<struct<source:string,target:string,from_id:string,to_id:string,type:string,rel_type:string,relation:string,description:string>>")),
        F.coalesce("g.edges", F.array().cast("array<struct<source:string,target:string,from_id:string,to_id:string,type:string,rel_type:string,relation:string,description:string>>")))))
    edges = both.select(
        F.coalesce("source", "from_id").alias("src"), F.coalesce("target", "to_id").alias("dst"),
        F.coalesce("type", "rel_type", "relation", F.lit("RELATED_TO")).alias("type"), F.coalesce("description", F.lit("")).alias("description"))
    return nodes, edges.filter("length(src) > 0 and length(dst) > 0")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Node and edge tables partitioned by type, plus type and degree statistics."""
    nodes.write.mode("overwrite").partitionBy("type").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")
    type_counts(nodes, edges).coalesce(1).write.mode("overwrite").json(f"{path}/type_counts")
    degree_stats(edges).write.mode("overwrite").parquet(f"{path}/degrees")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
