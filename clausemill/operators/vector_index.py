"""Approximate neighbours (R6) over a stored inverted file: coarse centres, lists on disk by centre, multi-probe search."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.functions.scale import top_per
from clausemill.operators.index import _matrix, _unit, meet

SAMPLE = 20_000  # vectors that centres and probes are fitted on, on the driver
MOST_LISTS = 1024
LIST_ROWS = 2_000  # vectors a list should hold
SLICE_ROWS = 50_000  # vectors of a list that one task looks at
ROUNDS = 12
TRIALS = 200  # sample vectors that serve as queries when the number of probes is chosen


@dataclass(frozen=True)
class VectorIndex:
    """lists(list, id, embedding) partitioned on disk by list; centres by number, vectors per list, and how many lists to probe."""

    lists: DataFrame
    centres: np.ndarray
    sizes: dict[int, int]
    probes: int
    id: str


def fit_centres(sample: np.ndarray, count: int) -> np.ndarray:
    """Unit centres of a sample by rounds of assigning and averaging; they start as rows spread over the sample, so a fit repeats."""
    centres = sample[np.linspace(0, len(sample) - 1, min(count, len(sample))).astype(int)]
    for _ in range(ROUNDS):
        near = (sample @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        held = np.bincount(near, minlength=len(centres)) > 0
        centres = np.where(held[:, None], _unit(total), centres)
    return centres


def fit_probes(sample: np.ndarray, centres: np.ndarray, k: int, target: float) -> int:
    """Fewest lists that hold `target` of the k nearest sample vectors of TRIALS sample vectors, counted in full."""
    near = (sample @ centres.T).argmax(axis=1)
    trials = sample[np.linspace(0, len(sample) - 1, min(TRIALS, len(sample))).astype(int)]
    best = np.argsort(-(trials @ sample.T), axis=1, kind="stable")[:, :k]
    order = np.argsort(-(trials @ centres.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)  # (trial, list) -> when the list is probed
    needed = np.sort(np.take_along_axis(place, near[best], axis=1).reshape(-1))
    return int(needed[int(np.ceil(target * len(needed))) - 1]) + 1 if len(needed) else 1


def write_vector_index(vectors: DataFrame, path: str, id: str = "vec_id", k: int = 10, target: float = 0.97, lists: int | None = None) -> None:
    """Stores every vector of `vectors`(id, embedding) in the list of its nearest centre (cosine; ties: smaller number).

    Centres are fitted on at most SAMPLE vectors, chosen by the hash of their id. `probes` is the fewest lists that reach `target`
    recall of the k nearest inside that sample; a search may ask for more. Rows without a vector are left out.
    """
    rows = vectors.select(id, F.col("embedding").cast("array<double>").alias("embedding")).filter("embedding IS NOT NULL")
    n = rows.count()
    head = rows.orderBy(F.xxhash64(id), id).limit(SAMPLE).select("embedding").collect()
    sample = _unit([r.embedding for r in head]) if head else np.empty((0, 1))
    spark = vectors.sparkSession
    count = lists or min(MOST_LISTS, max(1, -(-n // LIST_ROWS)))
    centres = fit_centres(sample, count) if n else np.zeros((1, 1))
    probes = fit_probes(sample, centres, k, target) if n else 1
    kind = rows.schema[id].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (_unit(_matrix(batch.column(1))) @ centres.T).argmax(axis=1) if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], [id, "embedding", "list"])

    dealt = rows.mapInArrow(assign, f"{id} {kind}, embedding array<double>, list int").hint("rebalance", "list")
    dealt.write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    held = spark.createDataFrame([(i, [float(x) for x in c], probes, id, kind) for i, c in enumerate(centres)], "list int, centre array<double>, probes int, id string, kind string")
    held.coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def read_vector_index(spark: SparkSession, path: str) -> VectorIndex:
    head = spark.read.parquet(f"{path}/centres").orderBy("list").collect()  # at most MOST_LISTS rows
    lists = spark.read.schema(f"{head[0].id} {head[0].kind}, embedding array<double>, list int").parquet(f"{path}/lists")
    sizes = {r.list: r.n for r in lists.groupBy("list").agg(F.count("*").alias("n")).collect()}
    return VectorIndex(lists, np.array([r.centre for r in head]), sizes, head[0].probes, head[0].id)


def probe_rows(queries: DataFrame, index: VectorIndex, probes: int) -> DataFrame:
    """query_id, embedding, list, slice: every query once for each slice of its `probes` nearest lists."""
    held = np.array(sorted(index.sizes), np.int64)  # lists that hold a row
    centres, parts = index.centres[held], {c: -(-n // SLICE_ROWS) for c, n in index.sizes.items()}
    kind = queries.schema["query_id"].dataType.simpleString()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lists, cuts = [], [], []
            if batch.num_rows and len(held):
                order = np.argsort(-(_unit(_matrix(batch.column(1))) @ centres.T), axis=1, kind="stable")[:, :probes]
                for i, own in enumerate(held[order].tolist()):
                    for c in own:
                        n = parts[c]
                        rows += [i] * n
                        lists += [c] * n
                        cuts += range(n)
            out = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(lists, pa.int32()), pa.array(cuts, pa.int32())], ["query_id", "embedding", "list", "slice"])

    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).filter("embedding IS NOT NULL")
    return asked.mapInArrow(route, f"query_id {kind}, embedding array<double>, list int, slice int")


def approximate_topk(queries: DataFrame, index: VectorIndex, k: int, probes: int | None = None, block: int = 4096) -> DataFrame:
    """R6, approximate: (query_id, id, score, rank) like `vector_topk`, looking only into each query's nearest lists.

    Every (list, slice) pair meets its own queries as a stream, in blocks, so a task holds one slice and one block, and no vector is
    sent more than once; only lists that some query probes are read and shuffled. With as many probes as lists the result is exact.
    """
    probes = min(probes or index.probes, len(index.centres))
    sent = probe_rows(queries, index, probes)
    probed = sorted(r.list for r in sent.select("list").distinct().collect())  # at most MOST_LISTS numbers
    id = index.id
    rows = index.lists.filter(F.col("list").isin(probed))  # partitions that hold no probed list are not read
    cuts = F.create_map(*[F.lit(v) for c in probed for v in (c, -(-index.sizes[c] // SLICE_ROWS))]) if probed else F.create_map(F.lit(0), F.lit(1))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64(id), cuts[F.col("list")]).cast("int"))
    found = meet(rows, sent, ["list", "slice"], k, id, block)
    return top_per(found, ["query_id"], [F.desc("score"), F.col(id)], k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """wanted, held: rows of the exact result, and how many of them the other result has, equal scores counting as found."""
    least = exact.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("wanted"))
    hits = found.join(least, "query_id").filter("score >= least").groupBy("query_id").agg(F.count("*").alias("held"))
    both = least.join(hits, "query_id", "left")
    return both.select("query_id", "wanted", F.least(F.coalesce("held", F.lit(0)), F.col("wanted")).alias("held"))
