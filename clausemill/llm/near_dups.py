"""Near-duplicate classes by weighted dart signatures, banded joining and an exact check of every candidate."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.functions.scale import kept_by, runs, salted_join, stored
from clausemill.llm.common import memo_of, texts_of

WORD = re.compile(r"\w+")
SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 28, 5  # a pair at 0.8 shares no band with probability 1.5e-5
TINY, PIVOTS = 8, 2  # larger buckets are first compared with so many pivots each
PART = 2_000  # members of a larger bucket that a task compares with as many others, without a row for every pair
SHINGLES = 2_000_000  # and their shingles, repeats counted
STRIP = 250  # members that are compared with a part at once
STEP = 50_000  # pairs whose signatures are compared in one step
ALIKE = 84  # equal coordinates of 140 that a pair must have to be verified; one at 0.8 has fewer with probability 1e-8
MEMO_ENTRIES = 300_000
SLICE_CHARS = 500_000  # texts that are turned into signatures or compared together
RUN = 500  # partners of one text that are verified in a row
NO_ID = -(2**63)  # stands for a null id in joins

MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
LOWEST = 6  # the first rank cell ends at 2^-LOWEST, the next ones double up to rank 1, then every cell is 1 wide
SCALE = 1 << 21  # ranks are compared in steps of 1 / SCALE
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.encode())
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        self[word] = h
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; arithmetic wraps."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed word shingles and their counts; a shorter text is one shingle, one without words has none."""
    words = [hashes[w] for w in WORD.findall(text.lower())]
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    w = np.array(words, np.uint64)
    width = min(SHINGLE, len(w))
    n = len(w) - width + 1
    h = np.full(n, width, np.uint64)
    for i in range(width):
        h = mix(h ^ (w[i : i + n] * MULTIPLIERS[i]))
    return np.unique(h, return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: sum of smaller over sum of larger counts."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - low
    return low / total if total else 0.0


def _poisson_table(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... darts in a cell of this area."""
    p, total, out, k = math.exp(-mean), 0.0, [], 0
    while total < 1 - 1e-15 and k < 40:
        total += p
        out.append(total)
        k += 1
        p *= mean / k
    return np.array(out)


CELLS = [(0.0, 2.0**-LOWEST), *((2.0 ** (i - 1), 2.0**i) for i in range(1 - LOWEST, 1))]
TABLES = {high - low: _poisson_table(high - low) for low, high in CELLS} | {1.0: _poisson_table(1.0)}


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """(len(sets), k) dart signatures of weighted sets; EMPTY where no dart fell.

    An element of weight w owns the region [0, w) x [0, infinity) of weight and rank, cut into cells of weight 1. The number of
    darts in a cell (Poisson, mean = its area), and each dart's coordinate, rank and weight position, are hashes of element and
    cell, so two sets see the same darts wherever both own the cell. A set of total weight W throws up to rank t / W with
    t = k ln k + 3k, about t darts whatever its size, and keeps the earliest dart of every coordinate. Two sets agree on a
    coordinate with probability equal to their weighted Jaccard similarity.
    """
    out = np.full((len(sets), k), EMPTY)
    totals = np.array([s[1].sum() for s in sets], float)
    order = [i for i in np.argsort(totals, kind="stable") if totals[i] > 0]  # small sets throw farthest: they come first
    if not order:
        return out
    elements, owners, tops = [], [], []
    for i in order:
        x, w = sets[i]
        cells = np.ceil(w).astype(np.int64)
        level = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
        elements.append(mix(np.repeat(x, cells) + (level + 1).astype(np.uint64) * MULTIPLIERS[0]))
        tops.append(np.minimum(np.repeat(w, cells) - level, 1.0))
        owners.append(np.full(len(level), i))
    element, owner, top = np.concatenate(elements), np.concatenate(owners), np.concatenate(tops)
    reach = ((k * math.log(k) + 3 * k) / totals)[owner]  # falls along the array
    flat = out.reshape(-1)
    n, at = len(element), 0
    while True:
        low, high = CELLS[at] if at < len(CELLS) else (float(at - len(CELLS) + 1), float(at - len(CELLS) + 2))
        n = int(np.searchsorted(-reach[:n], -low, side="left"))  # those with reach > low
        if not n:
            break
        cell = mix(element[:n] + np.uint64((at + 1) * int(MULTIPLIERS[1]) % 2**64))
        darts = np.searchsorted(TABLES[high - low], (cell >> np.uint64(11)) * 2.0**-53, side="right")
        hit = np.flatnonzero(darts)
        per = darts[hit]
        which = np.repeat(hit, per)
        number = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        dart = mix(cell[which] + (number + 1).astype(np.uint64) * MULTIPLIERS[2])
        place = mix(dart + MULTIPLIERS[3])
        rank = low + (high - low) * ((place >> np.uint64(32)) * 2.0**-32)
        inside = (place & np.uint64(0xFFFFFFFF)) * 2.0**-32 < top[which]
        slot = owner[which] * k + (dart % np.uint64(k)).astype(np.int64)
        value = (np.minimum(rank * SCALE, 2.0**32 - 1).astype(np.uint64) << np.uint64(32)) | (dart >> np.uint64(32))
        np.minimum.at(flat, slot[inside], value[inside])
        at += 1
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets, bands) keys; 0 where a coordinate of the band is empty."""
    cut = sig.reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * MULTIPLIERS[4], (len(sig), bands)).copy()
    for r in range(rows):
        key = mix(key ^ (cut[:, :, r] * MULTIPLIERS[r % 5]))
    key[(cut == EMPTY).any(axis=2)] = 0
    return key.view(np.int64)


def text_key(text: Column) -> Column:
    """16-byte digest of a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def slices(batch: pa.RecordBatch, columns: list[int]) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about SLICE_CHARS of text in the named columns; a row with longer texts is a part of its own."""
    sizes = sum(np.nan_to_num(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False)) for c in columns)
    start = size = 0
    for at, n in enumerate(sizes.tolist()):
        if at > start and (size + n > SLICE_CHARS or at - start >= 1000):
            yield batch.slice(start, at - start)
            start, size = at, 0
        size += n
    if batch.num_rows > start:
        yield batch.slice(start)


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key, bands (only those that hold a dart on every coordinate), size (number of shingles, repeats counted) and marks
    (the last byte of every coordinate) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo_of("near_dups")
        hashes = WordHashes()
        for batch in batches:
            for part in slices(batch, [2]):
                sets = [shingles(t, hashes) for t in texts_of(part.column(2))]
                sig = signatures(sets, BANDS * ROWS)
                keys = band_keys(sig, BANDS, ROWS)
                lists = pa.array([row[row != 0] for row in keys], pa.list_(pa.int64()))
                sizes = pa.array([int(s[1].sum()) for s in sets], pa.int64())
                marks = pa.array([m.tobytes() for m in mix(sig).astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists, sizes, marks], ["doc_id", "key", "bands", "size", "marks"])

    text = F.col(text_col).cast("string")
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text).alias("key"), text.alias("text"))
    return picked.mapInArrow(run, "doc_id long, key binary, bands array<long>, size long, marks binary")


def promising(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures agree on ALIKE coordinates; only these need their texts. Without `marks` all pairs stay."""
    if "marks" not in reps.columns:
        return pairs
    both = pairs.join(reps.select(F.col("key").alias("a"), F.col("marks").alias("x")), "a").join(reps.select(F.col("key").alias("b"), F.col("marks").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (marks_of(batch.column(c)) for c in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= ALIKE))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def marks_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def crossed(many: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Rows (bucket, i, j, side, key, root) of the texts whose exact comparison with the other side of their block (bucket, i, j) is
    needed. All members of a bucket (side 1) meet those outside its largest class (side 0). Pairs of one class, of sizes that cannot
    reach the similarity, or whose signatures agree on fewer than ALIKE coordinates need none (without `marks` the last holds for no
    pair), and a pair that shares more buckets is left to the smallest. many(bucket, key, size, root, main, light, lines, n, whole).

    Both sides are dealt into parts of about PART texts and SHINGLES shingles, and every two parts meet as a sorted stream, the texts
    outside first. A text is one row of a block, however many it may be alike to, so a bucket of any size is spread over many tasks.
    """
    known = "marks" in reps.columns
    rows = many.join(reps.select("key", "bands", "marks" if known else F.lit(None).cast("binary").alias("marks")), "key")
    parts = lambda c, size: F.ceil(F.greatest(F.col(c) / PART, F.col(size) / SHINGLES))
    outer, inner = parts("light", "lines"), parts("n", "whole")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    part = lambda n: F.pmod(F.xxhash64("key"), n)
    columns = ["bucket", "i", "j", "side", "key", "root", "size", "bands", "marks"]
    outside = rows.filter(F.col("root") != F.col("main")).withColumns({"side": F.lit(0), "i": part(outer)}).withColumn("j", every(inner))
    inside = rows.withColumns({"side": F.lit(1), "j": part(inner)}).withColumn("i", every(outer))
    stream = outside.select(*columns).union(inside.select(*columns)).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side")

    def needed(bucket: int, left: pa.RecordBatch, right: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Which rows of either side have a pair that must be compared exactly here."""
        roots = pa.concat_arrays([left.column("root"), right.column("root")]).dictionary_encode().indices.to_numpy()
        u, v = roots[: len(left)], roots[len(left) :]
        s, t = left.column("size").to_numpy(), right.column("size").to_numpy()
        x, y = np.nonzero((u[:, None] != v) & (np.minimum(s[:, None], t) >= least * np.maximum(s[:, None], t)))
        hit = np.zeros(len(left), bool), np.zeros(len(right), bool)
        if not len(x):
            return hit
        if known:
            m, n = marks_of(left.column("marks")), marks_of(right.column("marks"))
        width = pc.max(pc.list_value_length(pa.concat_arrays([left.column("bands"), right.column("bands")]))).as_py()
        own, others = padded(left.column("bands"), width, -1), padded(right.column("bands"), width, -2)
        own[own >= bucket] = -1  # only smaller buckets take a pair away; keys of -1 and -2 take none
        for at in range(0, len(x), STEP):
            a, b = x[at : at + STEP], y[at : at + STEP]
            if known:
                alike = (m[a] == n[b]).sum(axis=1) >= ALIKE
                a, b = a[alike], b[alike]
            here = ~((own[a] == others[b]) & (own[a] != -1)).any(axis=1)
            hit[0][a[here]] = hit[1][b[here]] = True
        return hit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, marked = None, [], []

        def outside_rows() -> Iterator[pa.RecordBatch]:
            for left, hit in zip(held, marked):
                yield left.select(columns[:6]).filter(pa.array(hit))

        for batch in batches:
            for own, side, some in runs(batch, 3):
                if own != group:
                    yield from outside_rows()
                    group, held, marked = own, [], []
                if side == 0:
                    held.append(some)
                    marked.append(np.zeros(len(some), bool))
                    continue
                for start in range(0, len(some), STRIP):
                    strip = some.slice(start, STRIP)
                    hit = np.zeros(len(strip), bool)
                    for left, seen in zip(held, marked):
                        x, y = needed(own[0], left, strip)
                        seen |= x
                        hit |= y
                    yield strip.select(columns[:6]).filter(pa.array(hit))
        yield from outside_rows()

    return stream.mapInArrow(run, "bucket long, i long, j long, side int, key binary, root binary")


def padded(lists: pa.Array, width: int, fill: int) -> np.ndarray:
    """Matrix of lists of at most `width` numbers, `fill` behind their ends."""
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    out = np.full((len(lists), width), fill, np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


class Postings:
    """Shingles of some texts with the texts that hold them, to count what another text shares with each."""

    def __init__(self, sets: list[tuple[np.ndarray, np.ndarray]]) -> None:
        flat = np.concatenate([s[0] for s in sets])
        order = np.argsort(flat, kind="stable")
        self.shingle, self.count = flat[order], np.concatenate([s[1] for s in sets])[order]
        self.owner = np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets])[order]
        self.totals = np.array([s[1].sum() for s in sets])

    def alike(self, other: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
        """Which texts have a weighted Jaccard similarity of `least` or more to the other one."""
        first = np.searchsorted(self.shingle, other[0], "left")
        per = np.searchsorted(self.shingle, other[0], "right") - first
        places = np.repeat(first - (np.cumsum(per) - per), per) + np.arange(per.sum())
        shared = np.minimum(self.count[places], np.repeat(other[1], per))
        low = np.bincount(self.owner[places], shared, len(self.totals)).astype(np.int64)
        total = self.totals + int(other[1].sum()) - low
        return (total > 0) & (low / np.maximum(total, 1) >= least)


def block_links(blocks: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that join the classes of every block, see `crossed`. Every text of one side is compared exactly with every text of
    the other inside the task; a pair becomes a row only if it joins two classes that were apart until then in its block."""
    columns = ["bucket", "i", "j", "side", "key", "root", "text"]
    stream = blocks.join(texts, "key").select(*columns).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo_of("near_dups")
        hashes = WordHashes()
        group = postings = at = None
        sets, keys, numbers, joined = [], [], {}, []  # of the block: texts outside, numbers of all classes, the class that each is part of

        def class_of(root: bytes) -> int:
            own = numbers.setdefault(root, len(numbers))
            if own == len(joined):
                joined.append(own)
            while joined[own] != own:
                own = joined[own]
            return own

        for batch in batches:
            for own, side, some in runs(batch, 3):
                if own != group:
                    group, postings, at = own, None, []
                    sets, keys, numbers, joined = [], [], {}, []
                for part in slices(some, [6]):
                    found = (shingles(t, hashes) for t in texts_of(part.column(6)))
                    classes = part.column(5).to_pylist()
                    if side == 0:
                        sets += found
                        keys += part.column(4).to_pylist()
                        at += map(class_of, classes)
                        continue
                    if postings is None:
                        postings, sets, at = Postings(sets), [], np.array(at)
                    a, b = [], []
                    for key, root, other in zip(part.column(4).to_pylist(), classes, found):
                        one = class_of(root)
                        linked = postings.alike(other, least)
                        while len(more := np.flatnonzero(linked & (at != one))):
                            gone = int(at[more[0]])
                            a.append(keys[more[0]])
                            b.append(key)
                            joined[gone] = one
                            at[at == gone] = one
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["x", "y"])

    return stream.mapInArrow(run, "x binary, y binary").select(*ordered("x", "y")).distinct()


def candidate_texts(keys: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """key, text of the texts in `keys`, each once. Rounds read these instead of all texts."""
    wanted = stored(keys.select("key").join(reps.select("key", "id"), "key"), "wanted")
    # Joined on the id too, so that the copies of one text do not meet in one task; equal rows are the only repeats left.
    return kept_by(texts, wanted, ["key", "id"]).groupBy("key").agg(F.first("text").alias("text"))


def verified(pairs: DataFrame, reps: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of text keys whose texts reach the similarity, counted exactly. `texts`: key, text, each key once.

    The text of a pair with more pairs is its centre. A centre's pairs are dealt into runs of about RUN, each a sorted stream of
    the centre's text and those of its partners, so a text that thousands are compared with is no hot key.
    """
    pairs = stored(promising(pairs, reps), "promising")
    degrees = stored(pairs.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("d")), "degrees")
    own = kept_by(texts, degrees.select("key"), ["key"])
    both = pairs.join(degrees.toDF("a", "da"), "a").join(degrees.toDF("b", "db"), "b")
    first = F.col("da") >= F.col("db")
    turned = both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("centre"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("other"),
                         F.greatest("da", "db").alias("d"))
    turned = stored(turned.select("centre", F.pmod(F.xxhash64("other"), F.ceil(F.col("d") / RUN)).alias("run"), "other"), "runs")
    partners = turned.join(own.withColumnRenamed("key", "other"), "other").select("centre", "run", "other", "text")
    centres = turned.select("centre", "run").distinct().join(own.withColumnRenamed("key", "centre"), "centre")
    stream = partners.union(centres.select("centre", "run", F.lit(None).cast("binary").alias("other"), "text"))
    stream = stream.repartition("centre", "run").sortWithinPartitions("centre", "run", F.col("other").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo_of("near_dups")
        hashes = WordHashes()
        middle = shingles("", hashes)
        for batch in batches:
            for part in slices(batch, [3]):
                keep = []
                for other, text in zip(part.column(2).to_pylist(), texts_of(part.column(3))):
                    own = shingles(text, hashes)
                    if other is None:  # a run begins with its centre
                        middle = own
                    keep.append(other is not None and similarity(own, middle) >= least)
                yield part.select(["centre", "other"]).filter(pa.array(keep, pa.bool_()))

    return stream.mapInArrow(run, "centre binary, other binary").select(*ordered("centre", "other"))


def ordered(x: str, y: str) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def crowded(members: DataFrame) -> DataFrame:
    """Members of buckets with two texts or more, with their number n."""
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return salted_join(members, sizes, ["bucket"], spread="key")


def near_links(reps: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Verified links (a, b) between distinct texts, see `linked`."""
    return linked(reps, texts, least)[0]


def linked(reps: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Verified links between distinct texts, and (key, root) of every linked text. `reps`: key, id (of one copy), bands, size[, marks].
    `texts`: key, id, text.

    Texts meet in band buckets. Every two texts of a tiny bucket are compared. In a larger one a few members (pivots: those that
    share most buckets with others, the text that copies were made of shares more than any copy) are compared with all members,
    and leave. Then all members are compared with those outside the bucket's largest class (`crossed`), so every two texts of a
    bucket are compared, whatever its size. Only pairs of one class, of sizes that cannot reach the similarity, or whose
    signatures are clearly too different are skipped. The texts of the others are compared in blocks inside tasks (`block_links`):
    links there join the classes of a block, pairs are no rows.
    """
    members = reps.select(F.explode("bands").alias("bucket"), "key", "size").withColumn("root", F.col("key"))
    members = stored(crowded(members), "members")
    popularity = stored(members.groupBy("key").agg(F.sum("n").alias("pop")), "popularity")
    texts = stored(candidate_texts(popularity, reps, texts), "texts")
    alike = F.least("size", "other_size") / F.greatest("size", "other_size") >= least  # similarity is at most this

    def meets(pivot: Column) -> Column:
        return (F.least("size", pivot.size) / F.greatest("size", pivot.size) >= least) & (F.col("root") != pivot.root)

    target = ["bucket", F.col("key").alias("other"), F.col("size").alias("other_size")]
    few, many = members.filter(F.col("n") <= TINY), members.filter(F.col("n") > TINY)
    close = few.join(few.select(*target), "bucket").filter((F.col("key") < F.col("other")) & alike).select(*ordered("key", "other"))
    pivots = stored(few_chosen(many.join(popularity, "key")), "pivots")
    met = salted_join(many, pivots, ["bucket"], spread="key").filter(F.exists("pivots", meets))
    spokes = met.select("key", F.explode(F.filter("pivots", meets)).alias("p")).select("key", F.col("p.key").alias("other"))
    tried = stored(close.union(spokes.select(*ordered("key", "other"))).distinct(), "pairs")
    found = stored(verified(tried, reps, texts, least), "links")
    roots = components(found)

    gone = pivots.select("bucket", F.explode("pivots.key").alias("key"))
    rooted = many.select("bucket", "key", "size").join(gone, ["bucket", "key"], "left_anti").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    per = rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("z"))
    per = per.groupBy("bucket").agg(F.sum("m").alias("n"), F.sum("z").alias("whole"), F.max(F.struct("m", "root", "z")).alias("top")).filter("n > top.m")
    state = per.select("bucket", F.col("top.root").alias("main"), (F.col("n") - F.col("top.m")).alias("light"), (F.col("whole") - F.col("top.z")).alias("lines"), "n", "whole")
    many = stored(salted_join(rooted, state, ["bucket"], spread="key"), "members")
    if many.isEmpty():
        return found, roots
    blocks = stored(crossed(many, reps, least), "blocks")
    links = stored(block_links(blocks, texts, least), "links")
    return found.union(links), joined_roots(roots, links)


def few_chosen(members: DataFrame) -> DataFrame:
    """bucket, pivots: up to PIVOTS members of every bucket, the text that shares most buckets in each slot. Slots go by text, so that
    buckets of one group choose the same ones."""
    slot = F.pmod(F.xxhash64("key", F.lit(0)), F.lit(PIVOTS))
    best = [F.max(F.when(slot == i, F.struct("pop", "key", "size", "root"))) for i in range(PIVOTS)]
    return members.groupBy("bucket").agg(F.array_compact(F.array(*best)).alias("pivots"))


def joined_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(key, root) after further links: only the roots that these join are linked anew."""
    if links.isEmpty():
        return roots
    ends = links.join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left")
    ends = ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).filter("a != b").distinct()
    moved = components(ends)
    old = roots.join(moved.toDF("root", "to"), "root", "left").select("key", F.coalesce("to", "root").alias("root"))
    return stored(old.union(moved.join(roots, "key", "left_anti")), "labels")


def components(links: DataFrame) -> DataFrame:
    """key, root: the smallest key of every linked component, by minimum labels with pointer jumping."""
    edges = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = stored(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("key"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = edges.join(labels.select(F.col("key").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        step = labels.join(near.withColumnRenamed("a", "key"), "key").select("key", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        jump = labels.select(F.col("key").alias("root"), F.col("root").alias("up"))
        new = stored(step.join(jump, "root", "left").select("key", "old", F.least("root", "up").alias("root")), "labels")
        labels = new.select("key", "root")
        if new.filter("old != root").isEmpty():
            return labels


def _classes(docs: DataFrame, id_col: str, text_col: str, least: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key) of the input, and (key, root) of every distinct text."""
    rows = stored(sketch(docs, id_col, text_col), "sketch")
    reps = rows.groupBy("key").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("id"), *(F.first(c).alias(c) for c in ("bands", "size", "marks")))
    text = F.col(text_col).cast("string")
    texts = docs.select(text_key(text).alias("key"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text"))
    _, roots = linked(reps, texts, least)
    keys = rows.select("key").distinct().join(roots, "key", "left").select("key", F.coalesce("root", "key").alias("root"))
    return rows.select("doc_id", "key"), keys


def near_dup_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, class_size of every row: a class joins equal texts and all chains of texts at `least` similarity or more.

    Similarity is weighted Jaccard over lower-cased word shingles (five words, counts as weights). class_id is the smallest
    doc_id of the class, class_size its number of rows. Null text counts as empty; texts without words are alike only when
    equal. Rows with a null id take part like others; a class of such rows only has a null class_id. Repeated rows are repeated
    in the result. An empty table gives no rows. Columns other than the two named are ignored.
    """
    rows, keys = _classes(docs, id_col, text_col, least)
    per_key = rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).join(keys, "key")
    per_root = per_key.groupBy("root").agg(F.min("first").alias("class_id"), F.sum("n").alias("class_size"))
    named = per_key.select("key", "root").join(per_root, "root").select("key", "class_id", "class_size")
    return rows.join(named, "key").select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` without near duplicates: of every class the row of smallest doc_id stays (nulls last), with all its columns.

    Of rows that share that id the one with the smallest text digest stays, and of equal rows one. Classes as in
    `near_dup_classes`.
    """
    rows, keys = _classes(docs, id_col, text_col, least)
    order = F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"), F.col("key").alias("k")))
    chosen = rows.join(keys, "key").groupBy("root").agg(order.alias("m"))
    chosen = chosen.select(F.coalesce("m.i", F.lit(NO_ID)).alias("__id"), F.col("m.k").alias("__key"))
    keyed = docs.withColumns({"__id": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), "__key": text_key(F.col(text_col).cast("string"))})
    one = F.row_number().over(Window.partitionBy("__id", "__key").orderBy("__key"))
    return keyed.join(chosen, ["__id", "__key"], "left_semi").withColumn("__n", one).filter("__n = 1").drop("__id", "__key", "__n")
