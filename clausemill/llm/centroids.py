"""Centroid clustering: Lloyd rounds on integer vectors; every nearest centroid is found by the threshold algorithm."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.functions.scale import stored
from clausemill.llm.common import whole_vectors

WIDTH = 64
CENTROIDS = 40
ROUNDS = 5
RUN = 1024  # vectors that are walked together: their distances to all centroids take a few megabytes
FAR = np.iinfo(np.int64).max


class Lists:
    """Sorted lists of centroid values, one for each dimension, and the walk along them."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = np.array(centroids, np.int64).reshape(len(centroids), -1)
        self.order = np.argsort(self.centroids, axis=0, kind="stable").T.copy()  # (dimension, place) -> centroid
        values = np.take_along_axis(self.centroids, self.order.T, axis=0).T
        edge = np.full((len(values), 1), FAR // 4)
        self.values = np.hstack([-edge, values, edge])  # a step past either end is never the nearer one while others are left

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (ties: the smaller) and squared distance of the nearest centroid of every row.

        In each step every dimension shows the next centroid outward from the row's value. Centroids seen for the first time get
        their exact distance. What no list has shown yet is at least as far away in every dimension as that list's last step, so
        a row ends when the sum of these squared steps exceeds its best distance, or when it has seen all centroids.
        """
        n, k = len(x), len(self.centroids)
        exact = np.full((n, k), FAR)
        dims = np.arange(x.shape[1])
        right = np.column_stack([np.searchsorted(self.values[d, 1:-1], x[:, d]) for d in dims]) + 1 if n else np.empty((0, len(dims)), np.int64)
        left = right - 1
        open_rows = np.arange(n)
        while len(open_rows):
            part = x[open_rows]
            down, up = part - self.values[dims, left], self.values[dims, right] - part
            lower = down <= up
            place = np.where(lower, left, right)
            left, right = left - lower, right + ~lower
            shown = np.zeros((len(open_rows), k), bool)
            shown[np.arange(len(open_rows))[:, None], self.order[dims, place - 1]] = True
            row, c = np.nonzero(shown & (exact[open_rows] == FAR))
            exact[open_rows[row], c] = ((part[row] - self.centroids[c]) ** 2).sum(axis=1)
            frontier = (np.where(lower, down, up) ** 2).sum(axis=1)
            seen = exact[open_rows]
            going = (frontier <= seen.min(axis=1)) & (seen == FAR).any(axis=1)
            open_rows, left, right = open_rows[going], left[going], right[going]
        best = exact.argmin(axis=1) if n else np.empty(0, np.int64)
        return best, exact[np.arange(n), best]


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and integer vectors of the kept rows, in runs."""
    for batch in batches:
        for at in range(0, batch.num_rows, RUN):
            part = batch.slice(at, RUN)
            kept, x = whole_vectors(part.column(1), WIDTH)
            yield part.column(0).take(pa.array(kept)), x


def seeds(vectors: DataFrame, count: int, salt: str) -> list[list[int]]:
    """The first `count` kept vectors by sha256 of salt:id, then by components; rows without an id are never seeds."""

    def run(batches):
        for ids, x in _vectors(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(list(x), pa.list_(pa.int64()))], ["id", "x"])

    hashed = vectors.filter("id IS NOT NULL").mapInArrow(run, "id long, x array<long>")
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    return [list(r.x) for r in hashed.select(digest.alias("h"), "x").orderBy("h", "x").limit(count).collect()]


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: floor(sum / count) of each cluster's vectors. Tasks send sums only; the driver gets one row per centroid and dimension."""
    lists = Lists(centroids)

    def run(batches):
        total = np.zeros(lists.centroids.shape, object)  # unbounded integers
        count = np.zeros(len(centroids), np.int64)
        for _, x in _vectors(batches):
            near, _ = lists.nearest(x)
            part = np.zeros(lists.centroids.shape, np.int64)
            np.add.at(part, near, x)
            total += part.astype(object)
            count += np.bincount(near, minlength=len(centroids))
        held = np.flatnonzero(count)
        columns = [np.repeat(held, WIDTH), np.tile(np.arange(WIDTH), len(held)), np.repeat(count[held], WIDTH)]
        sums = [str(v) for v in total[held].reshape(-1)]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(sums, pa.string())], ["cluster", "dim", "n", "s"])

    sums = vectors.mapInArrow(run, "cluster long, dim long, n long, s string")
    rows = sums.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    out = [list(c) for c in centroids]
    for r in rows:
        out[r.cluster][r.dim] = int(r.s) // r.n
    return out


def cluster(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = CENTROIDS, rounds: int = ROUNDS, salt: str = "2") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept row.

    Kept are rows whose vector has exactly 64 components, none null or non-finite; a component x counts as floor(256 x), held
    within 2^26 on both sides so that every distance fits 64 bits. `count` seeds (fewer rows: as many as there are), `rounds`
    rounds of assigning and moving, one last assignment. A row without an id is clustered like others but never a seed; repeated
    rows count each. Rows are read once a round and only sums leave the tasks. An empty table gives no rows; other columns are
    ignored.
    """
    vectors = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    centroids = seeds(vectors, count, salt)
    for _ in range(rounds if centroids else 0):
        centroids = moved(vectors, centroids)
    lists = Lists(centroids or [[0] * WIDTH])  # without seeds only rows without ids can be left

    def run(batches):
        for ids, x in _vectors(batches):
            near, distance = lists.nearest(x)
            yield pa.RecordBatch.from_arrays([ids, pa.array(near, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    placed = stored(vectors.mapInArrow(run, "vec_id long, cluster int, distance long"), "clusters")
    sums = {r.cluster: int(r.s) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in lists.centroids.tolist()]
    return placed.select(
        "vec_id", "cluster", "distance",
        by_number([sums.get(i, 0) for i in range(len(digests))], "long").alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"),
        by_number(digests, "string").alias("centroid_sha256"),
    )


def by_number(values: list, kind: str) -> Column:
    """The value of the row's cluster out of a short list."""
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)
