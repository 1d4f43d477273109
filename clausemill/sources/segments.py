"""A versioned inverted index of immutable segments (S10, W3): upserts and deletes by batch, delete lists, compaction."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.functions.scale import stored
from clausemill.operators.index import TextIndex, build_index
from clausemill.sources.index_store import DEFAULT_BUCKETS, term_bucket

POSTINGS = "term string, doc_id {0}, tf double, dl double, segment string, bucket int"
DOCS = "doc_id {0}, dl double, live boolean, segment string"
MANIFEST = "version long, seq long, segment string, batch string, kind string, buckets int"


@dataclass(frozen=True)
class Segment:
    """One entry of a manifest: its place in the order of changes, its folder, and the batches it holds (joined by a line break)."""

    seq: int
    segment: str
    batch: str


class SegmentedIndex:
    """Under `path`: postings/segment=/bucket=, docs/segment= and manifest/version=.

    A segment holds the postings and lengths of the chunks of its batch, and names every chunk that the batch replaces or removes
    (live = false where nothing replaces it). It never changes. A manifest version lists the segments that count; it is a single
    file that appears when it is whole, so readers see all of a batch or nothing. Folders that no manifest names are remains
    of lost writers and are not read.
    """

    def __init__(self, spark: SparkSession, path: str, id_type: str = "long", buckets: int = DEFAULT_BUCKETS):
        self.spark, self.path, self.kind, self.buckets = spark, path, id_type, buckets
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
        if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            spark.createDataFrame([], POSTINGS.format(id_type)).write.partitionBy("segment", "bucket").parquet(f"{path}/postings")
            spark.createDataFrame([], DOCS.format(id_type)).write.partitionBy("segment").parquet(f"{path}/docs")
            self._commit(0, [])
        else:
            head = self._manifest().first()
            self.kind, self.buckets = head.kind, head.buckets

    def _manifest(self) -> DataFrame:
        every = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        return every.filter(F.col("version") == (every.agg(F.max("version")).first()[0]))

    def _commit(self, version: int, segments: list[Segment]) -> None:
        """A second writer of the same version fails: the folder exists already."""
        rows = [(s.seq, s.segment, s.batch, self.kind, self.buckets) for s in segments] or [(-1, None, None, self.kind, self.buckets)]
        df = self.spark.createDataFrame(rows, "seq long, segment string, batch string, kind string, buckets int")
        df.coalesce(1).write.mode("error").parquet(f"{self.path}/manifest/version={version}")

    def state(self) -> tuple[int, list[Segment]]:
        """Newest version and its segments, oldest change first."""
        rows = self._manifest().orderBy("seq").collect()
        return rows[0].version, [Segment(r.seq, r.segment, r.batch) for r in rows if r.segment is not None]

    def apply(self, batch: str, upserts: DataFrame, deletes: DataFrame | None = None) -> bool:
        """Adds a batch: upserts(doc_id, text) replace or add chunks, deletes(doc_id) remove them; False where the batch is in already.

        Of rows with one id in a batch the one with the largest text is taken; an id that is both stays. Only the batch is
        tokenised and only buckets of its terms are written; older segments are not touched.
        """
        version, segments = self.state()
        if any(batch in s.batch.split("\n") for s in segments):
            return False
        one = stored(upserts.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("text").alias("text")), "upserts")
        name = f"s{uuid.uuid4().hex}"
        index = build_index(one)
        rows = index.postings.withColumn("bucket", term_bucket(self.buckets)).hint("rebalance", "bucket")
        self._write(rows, f"postings/segment={name}", ["bucket"])
        sizes = index.postings.groupBy("doc_id").agg(F.max("dl").alias("dl"))
        docs = one.select("doc_id").join(sizes, "doc_id", "left").select("doc_id", F.coalesce("dl", F.lit(0.0)).alias("dl"), F.lit(True).alias("live"))
        if deletes is not None:
            gone = deletes.select("doc_id").filter("doc_id IS NOT NULL").distinct().join(one.select("doc_id"), "doc_id", "left_anti")
            docs = docs.unionByName(gone.select("doc_id", F.lit(0.0).alias("dl"), F.lit(False).alias("live")))
        self._write(docs, f"docs/segment={name}", [])
        self._commit(version + 1, [*segments, Segment(segments[-1].seq + 1 if segments else 0, name, batch)])
        return True

    def _write(self, rows: DataFrame, folder: str, by: list[str]) -> None:
        if by:
            rows = rows.sortWithinPartitions(*by, "term")
        rows.write.partitionBy(*by).parquet(f"{self.path}/{folder}") if by else rows.write.parquet(f"{self.path}/{folder}")

    def _rows(self, table: str, schema: str, segments: list[Segment]) -> DataFrame:
        """Rows of the segments with their seq; other folders are pruned by name."""
        names = self.spark.createDataFrame([(s.segment, s.seq) for s in segments], "segment string, seq long")
        rows = self.spark.read.schema(schema.format(self.kind)).parquet(f"{self.path}/{table}")
        return rows.filter(F.col("segment").isin([s.segment for s in segments])).join(F.broadcast(names), "segment")  # as many rows as segments

    def _newest(self, segments: list[Segment]) -> DataFrame:
        """doc_id, seq, dl, live: the last change of every chunk."""
        last = F.max(F.struct("seq", "dl", "live")).alias("l")
        return self._rows("docs", DOCS, segments).groupBy("doc_id").agg(last).select("doc_id", "l.*")

    def read(self, query_terms: DataFrame | None = None) -> TextIndex:
        """The index as a fresh build of all live chunks would give it; with query terms(term) only their buckets are scanned."""
        _, segments = self.state()
        newest = stored(self._newest(segments), "live-chunks")
        postings = self._rows("postings", POSTINGS, segments)
        if query_terms is not None:
            wanted = query_terms.select("term").distinct().withColumn("bucket", term_bucket(self.buckets))
            postings = postings.join(wanted, ["bucket", "term"], "left_semi")
        live = postings.join(newest.filter("live").select("doc_id", "seq"), ["doc_id", "seq"], "left_semi").select("term", "doc_id", "tf", "dl")
        terms = live.groupBy("term").agg(F.count("*").alias("df"))
        corpus = newest.filter("live").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        return TextIndex(live, terms, corpus)

    def compact(self, most: int | None = None) -> int:
        """Merges the newest segments, all or the last `most`, into one without dead rows; returns how many segments are left.

        The new segment takes the place of the last one merged and holds their batches, so repeated batches are still known. A
        chunk removed in it stays named while older segments are left that may hold it.
        """
        version, segments = self.state()
        old, merged = (segments[:-most], segments[-most:]) if most else ([], segments)
        if len(merged) < 2:
            return len(segments)
        newest = stored(self._newest(merged), "live-chunks")
        name = f"s{uuid.uuid4().hex}"
        rows = self._rows("postings", POSTINGS, merged).join(newest.filter("live").select("doc_id", "seq"), ["doc_id", "seq"], "left_semi")
        self._write(rows.select("term", "doc_id", "tf", "dl", "bucket").hint("rebalance", "bucket"), f"postings/segment={name}", ["bucket"])
        kept = newest if old else newest.filter("live")
        self._write(kept.select("doc_id", "dl", "live"), f"docs/segment={name}", [])
        self._commit(version + 1, [*old, Segment(merged[-1].seq, name, "\n".join(s.batch for s in merged))])
        return len(old) + 1

    def follow(self, changes: DataFrame, checkpoint: str, merge_at: int = 16):
        """A streaming writer. `changes`(doc_id, text, deleted) per micro-batch, merged when there are `merge_at` segments; start it with .start()."""
        name = uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex

        def step(rows: DataFrame, number: int) -> None:
            rows = stored(rows.select("doc_id", "text", F.coalesce("deleted", F.lit(False)).alias("deleted")), "changes")
            self.apply(f"{name}-{number}", rows.filter("NOT deleted").select("doc_id", "text"), rows.filter("deleted").select("doc_id"))
            if len(self.state()[1]) >= merge_at:
                self.compact()

        return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
