"""Streaming queries over the events table and over files that Spark derives from the documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from clausemill.catalog.base import Tables, query
from clausemill.functions.scale import stored_root
from clausemill.streaming import operators as so

DAY = 86400
ADMIT = f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, event_id, i, true AS accepted, [s] AS kept FROM e WHERE i = 1 UNION ALL
  SELECT e.user_id, e.event_id, e.i, len(list_filter(kept, lambda x: x > s - {DAY})) < 2 AS accepted,
    CASE WHEN len(list_filter(kept, lambda x: x > s - {DAY})) < 2 THEN list_append(list_filter(kept, lambda x: x > s - {DAY}), s) ELSE list_filter(kept, lambda x: x > s - {DAY}) END AS kept
  FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id::VARCHAR AS key, event_id, accepted FROM r"""


def stream(t: Tables, name: str = "events"):
    schema = t(name).schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.dir)


@query("admission", ADMIT)
def admission(t):
    return so.admission_batch(t("events"), "user_id", 2, DAY)


@query("admission_stream", ADMIT)
def admission_stream(t):
    out = so.run_to_table(so.admission(stream(t), "user_id", 2, DAY), "admission", "append")
    return out.select("key", "event_id", "accepted")


@query(
    "rolling_metrics",
    "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS highest FROM events GROUP BY ALL",
)
def rolling_metrics(t):
    out = so.run_to_table(so.rolling_metrics(stream(t), "event_type", "value"), "rolling", "update", ["start", "event_type"])
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"), "highest")


@query(
    "last_n_metrics",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type AS key, max(n) AS n, round(avg(value), 6) AS mean FROM r WHERE i <= 1000 GROUP BY event_type""",
)
def last_n_metrics(t):
    out = so.run_to_table(so.last_n_metrics(stream(t), "event_type", "value"), "last", "update", ["key"])
    return out.withColumn("mean", F.round("mean", 6))


@query(
    "feedback",
    """SELECT lower(event_type) || (user_id % 50) AS signature, arg_max(value, (ts, event_id)) AS last_value, count(*) AS n FROM events GROUP BY signature""",
)
def feedback(t):
    s = stream(t).withColumn("query", F.concat(F.initcap("event_type"), F.lit(" - "), F.col("user_id") % 50, F.lit("?")))
    return so.run_to_table(so.feedback(s, "query", "value"), "feedback", "update", ["signature"]).drop("last_ts")


def folder(t: Tables, name: str) -> str:
    return f"{stored_root(t.spark)}/derived/{name}-{uuid.uuid4().hex}"


@query("detect_new_files", "SELECT DISTINCT source FROM documents")
def detect_new_files(t):
    path = folder(t, "files")
    t("documents").select("source", "text").write.partitionBy("source").text(path)
    files = so.run_to_table(so.detect_new_files(t.spark, path, "*.txt"), "files", "append")
    return files.select(F.regexp_extract("path", "source=([^/]+)", 1).alias("source")).distinct()


@query("upsert_chunks", "SELECT doc_id::VARCHAR AS chunk_id, md5(CASE WHEN lang = 'en' THEN 'new ' || text ELSE text END) AS digest FROM documents")
def upsert_chunks(t):
    path, out, state = folder(t, "chunks"), folder(t, "store"), folder(t, "state")
    d = t("documents")
    rows = d.select(F.col("doc_id").cast("string").alias("chunk_id"), "text", F.lit(1).alias("seq"))
    rows.union(rows.withColumns({"text": F.lit("copy"), "seq": F.lit(2)})).write.parquet(path)
    source = lambda: t.spark.readStream.schema("chunk_id string, text string, seq int").parquet(path)
    so.upsert_chunks(source(), out, state)
    changed = d.filter("lang = 'en'").select(F.col("doc_id").cast("string").alias("chunk_id"), F.concat(F.lit("new "), "text").alias("text"), F.lit(1).alias("seq"))
    changed.write.mode("append").parquet(path)
    so.upsert_chunks(source(), out, state)
    return so.current_chunks(t.spark, out).select("chunk_id", F.md5("text").alias("digest"))
