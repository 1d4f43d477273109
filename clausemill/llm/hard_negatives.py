"""Hard-negative mining by inner product over cover trees of norm-augmented vectors."""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.functions.scale import stored
from clausemill.llm.common import LARGEST

TREE_ROWS = 4096  # rows of one tree
REGIONS = 1024  # at most so many centres on the top level; more rows give more slices of a region
SAMPLE = 4096  # rows that the centres are chosen from
LEAF = 128
FEW = 12  # balls of fewer rows share a leaf
BATCH = 4096  # anchors that meet a tree in one task
BASE = 1.5  # ratio of the covering radii of neighbouring levels
NONE = np.iinfo(np.int64).min


def whole(vector: Column) -> Column:
    """floor(256 x) of every component, within 2^26 on both sides; null where the vector or any component is null or not finite."""
    wide = vector.cast("array<double>")
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    held = F.transform(wide, lambda x: F.least(F.greatest(F.floor(x * 256), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int"))
    return F.when(F.coalesce(fine, F.lit(False)), held)


def matrix(lists: list[list[int]], width: int = 0) -> np.ndarray:
    """Rows filled up with zeros to the longest one, or to `width`."""
    width = max([width, *map(len, lists)])
    out = np.zeros((len(lists), width), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def augmented(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors with one more component that gives all of them the squared norm `top`."""
    norms = (x.astype(float) ** 2).sum(axis=1)
    return np.column_stack([x.astype(float), np.sqrt(np.maximum(top - norms, 0.0))])


def bounds(query: np.ndarray, centres: np.ndarray, radii: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of a query with anything inside balls of augmented vectors.

    All augmented vectors have squared norm `top` and the query a last component of 0, so an inner product falls with the
    distance d: it is (|q|^2 + top - d^2) / 2, and d lies within the radius of the distance to the centre.
    """
    size = float((query.astype(float) ** 2).sum())
    wide = np.zeros(centres.shape[1])
    wide[: len(query)] = query
    d = np.sqrt(np.maximum(((centres - wide) ** 2).sum(axis=1), 0.0))
    slack = 1e-9 * (size + top) + 1e-3
    low = (size + top - (d + radii) ** 2) / 2 - slack
    return low, (size + top - np.maximum(d - radii, 0.0) ** 2) / 2 + slack


class Tree:
    """A forest with one cover tree for each label under a common root. Rows of a node lie side by side.

    A level with radius r holds centres more than r apart that cover the node's rows within r; the next level's radius is
    smaller by BASE. Every node keeps the radius it really needs. Rows in small balls share one leaf.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, top: float):
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.x, self.top = ids[order], labels[order], x[order], top
        self.points = augmented(self.x, top)
        self.place = np.arange(len(order))
        self.nodes: list[tuple[int, int, int, float, int, int]] = []  # start, end, centre row, radius, first and last child
        edges = np.flatnonzero(np.r_[True, self.labels[1:] != self.labels[:-1], True])
        self.nodes.append((0, len(order), 0, math.inf, 1, len(edges)))
        open_nodes = []
        for a, b in zip(edges, edges[1:]):
            d = self._far(np.arange(a, b), a)
            open_nodes.append((len(self.nodes), d))
            self.nodes.append((int(a), int(b), int(a), float(d.max(initial=0.0)), 0, 0))
        while open_nodes:
            self._split(*open_nodes.pop(), open_nodes)
        self.ids, self.labels, self.x, self.points = (v[self.place] for v in (self.ids, self.labels, self.x, self.points))
        where = np.empty_like(self.place)
        where[self.place] = np.arange(len(where))
        table = np.array(self.nodes)
        self.spans, self.children, self.radii = table[:, :2].astype(int), table[:, 4:].astype(int), table[:, 3]
        self.centres = self.points[where[table[:, 2].astype(int)]]

    def _far(self, rows: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(((self.points[rows] - self.points[centre]) ** 2).sum(axis=1))

    def _split(self, node: int, far: np.ndarray, open_nodes: list) -> None:
        start, end, centre, radius, _, _ = self.nodes[node]
        if end - start <= LEAF or radius == 0.0:
            return
        rows, reach = self.place[start:end], radius
        while True:
            reach /= BASE
            parts, left, d, c = [], np.arange(len(rows)), far, centre
            while len(left):
                near = d <= reach
                parts.append((c, left[near], d[near]))
                left = left[~near]
                if len(left):
                    c = int(rows[left[0]])
                    d = self._far(rows[left], c)
            if len(parts) > 1:
                break
        few = [p for p in parts if len(p[1]) < FEW]
        groups = [p for p in parts if len(p[1]) >= FEW]
        if len(few) > 1:
            own = np.concatenate([p[1] for p in few])
            groups.append((centre, own, far[own]))
        else:
            groups += few
        first, at = len(self.nodes), start
        if len(groups) == 1:  # all balls are small
            return
        self.place[start:end] = rows[np.concatenate([g[1] for g in groups])]
        for i, (c, own, d) in enumerate(groups):
            if len(own) > LEAF and not (len(few) > 1 and i == len(groups) - 1):
                open_nodes.append((len(self.nodes), d))
            self.nodes.append((at, at + len(own), c, float(d.max()), 0, 0))
            at += len(own)
        self.nodes[node] = (start, end, centre, radius, first, len(self.nodes))

    def descend(self, query: np.ndarray, own: int, same: bool, tops: list[Best]) -> None:
        """Best-first: the node with the largest bound comes next; nodes outside all windows are skipped, leaves are computed exactly."""
        x = np.zeros(self.x.shape[1], self.x.dtype)
        x[: len(query)] = query
        least, most = np.array([t.least for t in tops], float), np.array([t.most for t in tops], float)
        heap = [(-math.inf, 0)]
        while heap:
            high, node = heapq.heappop(heap)
            if -high < least.min():
                return
            a, b = self.children[node]
            if a == b:
                start, end = self.spans[node]
                if (self.labels[start] == own) != same:
                    continue
                scores = self.x[start:end] @ x
                fits = np.flatnonzero((scores >= min(t.least for t in tops)) & (scores <= max(t.most for t in tops)))
                if len(fits):
                    scores, ids = scores[fits].astype(np.int64), self.ids[start:end][fits]
                    for i, t in enumerate(tops):
                        own_fits = (scores >= t.least) & (scores <= t.most)
                        if own_fits.any():
                            t.add(scores[own_fits], ids[own_fits])
                            least[i] = t.least
                continue
            picked = np.arange(a, b)
            if node == 0:
                picked = picked[(self.labels[self.spans[picked, 0]] == own) == same]
            low, high = bounds(query, self.centres[picked], self.radii[picked], self.top)
            inside = ((high[:, None] >= least) & (low[:, None] <= most)).any(axis=1)
            for n, h in zip(picked[inside].tolist(), high[inside].tolist()):
                heapq.heappush(heap, (-h, n))


class Best:
    """The first k (score, id) of a window of scores. `least` rises once k are known; an equal score may still have a smaller id."""

    def __init__(self, k: int, least: float, most: float, skip: int | None = None):
        self.k, self.least, self.most, self.skip, self.rows = k, least, most, skip, []

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fresh = [(-s, i) for s, i in zip(scores.tolist(), ids.tolist()) if i != self.skip]
        self.rows = heapq.nsmallest(self.k, self.rows + fresh)
        if len(self.rows) == self.k:
            self.least = max(self.least, -self.rows[-1][0])


def centres_of(sample: np.ndarray, count: int, top: float) -> np.ndarray:
    """Rows of a sample, each the farthest from those before it: a net whose covering radius falls with every row."""
    points = augmented(sample, top)
    chosen, d = [0], ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < count and d.max() > 0:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


class Forest:
    """Stored trees and their regions. A region is all rows nearest to one centre; it is dealt by id into slices of one tree each."""

    def __init__(self, items: DataFrame):
        """`items`: id, label (codes), x."""
        norm = F.aggregate("x", F.lit(0).cast("long"), lambda s, v: s + v.cast("long") * v)
        facts = items.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("top"), F.max(F.size("x")).alias("width")).first()
        self.n, self.top, self.width = facts.n, float(facts.top or 0), facts.width or 0
        rows = items.select("id", "x").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()  # bounded
        sample = matrix([r.x for r in rows], self.width)
        self.centres = centres_of(sample, min(REGIONS, -(-self.n // TREE_ROWS)), self.top) if rows else sample
        self.rows = stored(items.mapInArrow(self._placed, "id long, label long, x array<int>, region int, far double"), "regions")
        sizes = self.rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()  # at most REGIONS
        self.radii = np.full(len(self.centres), -1.0)
        self.slices = np.zeros(len(self.centres), int)
        for r in sizes:
            self.radii[r.region], self.slices[r.region] = r.radius, -(-r.n // TREE_ROWS)
        parts = F.element_at(F.array(*[F.lit(max(1, int(s))) for s in self.slices] or [F.lit(1)]), F.col("region") + 1)
        dealt = self.rows.withColumn("slice", F.pmod(F.xxhash64("id"), parts).cast("int"))
        self.trees = stored(dealt.groupBy("region", "slice").applyInArrow(self._built, "region int, slice int, tree binary"), "trees")

    @property
    def _placed(self):
        points, top, width = augmented(self.centres, self.top), self.top, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, TREE_ROWS):
                    part = batch.slice(at, TREE_ROWS)
                    x = augmented(matrix(part.column(2).to_pylist(), width), top)
                    d = (x**2).sum(axis=1)[:, None] + (points**2).sum(axis=1) - 2 * x @ points.T
                    region = d.argmin(axis=1)
                    far = np.sqrt(((x - points[region]) ** 2).sum(axis=1))
                    columns = [*part.columns, pa.array(region, pa.int32()), pa.array(far, pa.float64())]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "label", "x", "region", "far"])

        return run

    @property
    def _built(self):
        top, width = self.top, self.width

        def run(key, table):
            ids, labels = table.column("id").to_numpy(), table.column("label").to_numpy()
            return pa.table({"region": pa.array([key[0].as_py()], pa.int32()), "slice": pa.array([key[1].as_py()], pa.int32()),
                             "tree": [packed(Tree(ids, labels, matrix(table.column("x").to_pylist(), width), top))]})

        return run

    def search(self, anchors: DataFrame, k: int, same: bool, where: str) -> DataFrame:
        """anchor, positive, id, score: each tree's first k rows of every window.

        `anchors`: anchor, label, x, region, floor (least score worth having), windows array<struct<positive, least, most>>.
        `where`: "home" looks into the anchor's own region, "away" into all others that may hold such a score, "all" into both.
        A region's rows meet the anchors in slices and batches, so no task gets all of either.
        """
        centres, radii, slices, top = augmented(self.centres, self.top), self.radii, self.slices, self.top
        total = anchors.count()
        batches = max(1, -(-total // BATCH))

        def routed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                anchor_rows, regions, cut = [], [], []
                for i, row in enumerate(part.select(["x", "region", "floor", "windows"]).to_pylist()):
                    _, high = bounds(np.array(row["x"], np.int64), centres, radii, top)
                    open_regions = (radii >= 0) & (high >= row["floor"])
                    if where != "all":
                        home = np.arange(len(radii)) == row["region"]
                        open_regions &= home if where == "home" else ~home
                    for r in np.flatnonzero(open_regions).tolist():
                        anchor_rows += [i] * slices[r]
                        regions += [r] * slices[r]
                        cut += range(slices[r])
                out = part.drop_columns(["region"]).take(pa.array(anchor_rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(regions, pa.int32()), pa.array(cut, pa.int32())], [*out.schema.names, "region", "slice"])

        kinds = dict(anchors.dtypes)
        fields = ", ".join(f"{c} {kinds[c]}" for c in anchors.columns if c != "region")
        sent = anchors.mapInArrow(routed, f"{fields}, region int, slice int")
        sent = sent.withColumn("batch", F.pmod(F.xxhash64("anchor"), F.lit(batches)).cast("int"))
        met = sent.select("region", "slice", "batch").distinct()
        trees = self.trees.join(met, ["region", "slice"]).toDF("tree_region", "tree_slice", "tree", "tree_batch")

        def found(key, left, right):
            out: list[tuple] = []
            if len(right) and len(left):
                tree = unpacked(right.column("tree")[0].as_py())
                for row in left.to_pylist():
                    if same:
                        tops, names = [Best(k, row["floor"], math.inf, row["anchor"])], [None]
                    else:
                        tops = [Best(k, w["least"], w["most"]) for w in row["windows"]]
                        names = [w["positive"] for w in row["windows"]]
                    tree.descend(np.array(row["x"], np.int64), row["label"], same, tops)
                    out += [(row["anchor"], p, i, -s) for p, t in zip(names, tops) for s, i in t.rows]
            columns = list(zip(*out)) or [(), (), (), ()]
            return pa.table([pa.array(c, pa.int64()) for c in columns], ["anchor", "positive", "id", "score"])

        keys = ("region", "slice", "batch")
        return sent.groupBy(*keys).cogroup(trees.groupBy(*(f"tree_{c}" for c in keys))).applyInArrow(found, "anchor long, positive long, id long, score long")


ARRAYS = ("ids", "labels", "x", "spans", "children", "radii", "centres")


def packed(tree: Tree) -> bytes:
    out = io.BytesIO()
    np.savez(out, top=tree.top, **{a: getattr(tree, a) for a in ARRAYS} | {"x": tree.x.astype(np.int32)})
    return out.getvalue()


def unpacked(data: bytes) -> Tree:
    tree = Tree.__new__(Tree)
    with np.load(io.BytesIO(data)) as arrays:
        tree.top = float(arrays["top"])
        for a in ARRAYS:
            setattr(tree, a, arrays[a])
    tree.x = tree.x.astype(float if tree.top < 2**53 else np.int64)  # below that, products and their sums are exact as floats
    return tree


def mine(rows: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", every: int = 100,
         positives: int = 5, negatives: int = 5, share: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every anchor and positive.

    Anchors are rows whose id is divisible by `every`. A score is the inner product of two integer vectors (a component x counts
    as floor(256 x), held within 2^26 on both sides; a shorter vector counts as filled up with zeros). Higher scores come first,
    then smaller ids. Positives are an anchor's first other rows of its label; negatives are the first rows of other labels whose
    score is at least `share` % of the positive's and at most equal to it. A positive without such rows gives no row.

    Rows with a null id or label, a null vector, or any null or non-finite component take no part. Of rows with one id the one
    with the smallest label, then vector, takes part. Labels may be of any type that sorts. Other columns are ignored; an empty
    table gives no rows.
    """
    picked = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("name"), whole(F.col(vector_col)).alias("x")).dropna()
    one = picked.groupBy("id").agg(F.min(F.struct("name", "x")).alias("m"))
    items = stored(one.select("id", F.xxhash64("m.name").alias("label"), "m.x"), "vectors")
    forest = Forest(items)
    windows = F.array().cast("array<struct<positive:bigint,least:bigint,most:bigint>>").alias("windows")
    anchors = forest.rows.filter(F.col("id") % every == 0).select(F.col("id").alias("anchor"), "label", "x", "region", F.lit(NONE).alias("floor"), windows)
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")

    def first(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= positives).drop("rank")

    home = stored(first(forest.search(anchors, positives, True, "home")), "home")
    reach = home.groupBy("anchor").agg(F.when(F.count(F.lit(1)) == positives, F.min("score")).alias("reach"))
    raised = anchors.join(reach, "anchor", "left").withColumn("floor", F.coalesce("reach", "floor")).select(*anchors.columns)
    chosen = stored(first(home.union(forest.search(raised, positives, True, "away"))).select("anchor", F.col("id").alias("positive"), "score"), "positives")

    least = F.ceil(F.col("score").cast("decimal(20,0)") * share / 100).cast("long")
    window = F.struct("positive", least.alias("least"), F.col("score").alias("most"))
    asked = chosen.filter(least <= F.col("score")).groupBy("anchor").agg(F.collect_list(window).alias("windows"))  # at most `positives` entries
    sent = anchors.drop("windows").join(asked, "anchor").withColumn("floor", F.array_min(F.transform("windows", lambda w: w["least"])))
    found = forest.search(sent.select(*anchors.columns), negatives, False, "all")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= negatives)
    return ranked.join(chosen.withColumnRenamed("score", "positive_score"), ["anchor", "positive"]).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
