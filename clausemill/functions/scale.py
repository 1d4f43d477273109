"""Helpers that keep plans safe on skewed and very large inputs."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_SALTS = 1


# Adds size(array) > 0 below every explode. Here the arrays are regex results, so each text would be tokenised twice.
DOUBLE_EVALUATION = "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate"


# Shuffled bytes that adaptive execution gathers for one task. Tokens and hash tables take ten times as much and more.
TASK_BYTES = "16m"


def tune(spark: SparkSession) -> SparkSession:
    """Runtime SQL settings every job wants: adaptive re-planning, tasks of bounded size, skew splitting, UTC, single evaluation of arrays."""
    excluded = (spark.conf.get("spark.sql.optimizer.excludedRules", "") or "").split(",")
    rules = ",".join(dict.fromkeys([*[r for r in excluded if r], DOUBLE_EVALUATION]))
    for key, value in {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": TASK_BYTES,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.optimizer.excludedRules": rules,
    }.items():
        spark.conf.set(key, value)
    return spark


def salts(spark: SparkSession) -> int:
    """Slices every key is cut into. 1 leaves hot keys to the adaptive split, which acts on measured sizes."""
    return int(spark.conf.get("clausemill.salts", str(DEFAULT_SALTS)))


def salted_join(big: DataFrame, small: DataFrame, on: list[str], spread: str, how: str = "inner") -> DataFrame:
    """Equi-join whose hot keys are split: by the adaptive skew join where a shuffled key turns out large, so nothing is copied otherwise.

    With `clausemill.salts` above 1 every key of `big` is cut into so many slices by the hash of its `spread` column instead, and
    `small` is repeated once per slice: for plans in which adaptive splitting does not apply (below a window on the join key).
    No broadcast is forced: Spark picks it by measured size, otherwise both sides shuffle.
    `how` may be inner, left or left_semi (big on the left).
    """
    n = salts(big.sparkSession)
    if n <= 1:
        return big.join(small, on, how)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(n)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


# A broadcast side of at most this many narrow rows (a key, a term, two numbers) stays near 50 MB.
BROADCAST_ROWS = 500_000


def checked_join(big: DataFrame, small: DataFrame, on: list[str], spread: str, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Inner join that broadcasts `small` only after counting it; above the bound both sides are shuffled and salted.

    `small` should be stored (see `stored`), so that counting reads file footers only.
    """
    if small.limit(max_rows + 1).count() <= max_rows:
        return big.join(F.broadcast(small), on)
    return salted_join(big, small, on, spread)


def kept_by(big: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Rows of `big` with a partner in `small`, a stored table; up to BROADCAST_ROWS of it are broadcast, so that `big` is not shuffled."""
    few = small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return big.join(F.broadcast(small) if few else small, on, "left_semi")


# Bytes of a text file (compressed, about a third of the text) that one task reads; its tokens take ten times as much and more.
SCAN_BYTES = 4 << 20


def file_bytes(spark: SparkSession, path: str) -> int:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


FIRST_PARTS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def deal_finely(spark: SparkSession, size: int) -> None:
    """Lets shuffles start with a part for every SCAN_BYTES of a table of `size` bytes, so that a part does not grow with the table.
    Adaptive execution gathers small parts; `spark.sql.shuffle.partitions` stays the least number."""
    own, first = int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get(FIRST_PARTS, None) or 0)
    parts = max(own, first, -(-size // SCAN_BYTES))
    if first or parts > own:
        spark.conf.set(FIRST_PARTS, str(parts))


def spread_out(df: DataFrame, size: int = 0) -> DataFrame:
    """Shares a scan over all cores, and over tasks of SCAN_BYTES each where `size` bytes are larger, before heavy text work."""
    parts = max(min(df.sparkSession.sparkContext.defaultParallelism, 32), -(-size // SCAN_BYTES))
    if df.rdd.getNumPartitions() >= parts:
        return df
    return df.repartition(max(parts, df.sparkSession.sparkContext.defaultParallelism))


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder named by the cluster. Only a session on one machine may do without; it gets a private one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="clausemill-ckpt-")
        spark.sparkContext.setCheckpointDir(root)
    return root


_owned: dict[str, object] = {}  # folder -> file system settings of its application


def stored_root(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is removed when the application ends."""
    path = f"{checkpoint_root(spark)}/stored-{spark.sparkContext.applicationId}"
    if path not in _owned:
        _owned[path] = spark.sparkContext._jsc.hadoopConfiguration()
        atexit.register(drop_stored, spark, path)
    return path


def drop_stored(spark: SparkSession, path: str | None = None) -> None:
    """Removes what `stored` wrote for this application. Call it when a job is done and its result is written."""
    path = path or stored_root(spark)
    try:
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(_owned[path]).delete(where, True)
    except Exception as gone:  # at exit the gateway may have ended; the cluster's clean-up of the folder then applies
        print(f"left behind: {path} ({type(gone).__name__})", file=sys.stderr)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an iteration's state to reliable storage and read on from there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_root(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes an intermediate result that several steps read to the shared folder, and reads it back.

    It is computed once, later readers prune its columns, and a lost executor costs a re-read, not a re-computation.
    """
    path = f"{stored_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key. Spark prunes each partition to k rows per key before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def global_top(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """Overall first k rows as TakeOrdered (per-partition heaps, no full sort)."""
    return df.orderBy(*order).limit(k)


def running_rank(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], out: str = "rn") -> DataFrame:
    """1-based row number per key without sorting a whole key in one task.

    `bucket` must not decrease along `order`. Rows are numbered inside (key, bucket); the offset of a
    bucket is the running sum over the much smaller bucket counts.
    """
    from pyspark.sql import Window

    rows = df.withColumn("_b", bucket)
    counts = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_b", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    inside = rows.withColumn("_in", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)))
    return inside.join(offsets, [*keys, "_b"]).withColumn(out, F.col("_in") + F.col("_off")).drop("_b", "_in", "_off")


def exact_percentile(df: DataFrame, keys: list[str], value: str, bucket: Column, percents: list[int]) -> DataFrame:
    """Element floor(n*p/100) (0-based, capped) of the sorted values of every key, without collecting them.

    Equal values are pre-counted, a running count over value buckets finds the bucket that holds the
    wanted position, and only inside that bucket values are ranked. Output: keys, p, value.
    """
    from pyspark.sql import Window

    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, bucket.alias("_b"), F.col(value)).agg(F.count(F.lit(1)).alias("_n"))
    per_bucket = counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"))
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = Window.partitionBy(*keys)
    spans = per_bucket.withColumn("_hi", F.sum("_bn").over(w)).withColumn("_total", F.sum("_bn").over(total))
    wanted = (
        spans.withColumn("p", F.explode(F.array(*[F.lit(p) for p in percents])))
        .withColumn("_pos", F.least(F.floor(F.col("_total") * F.col("p") / 100), F.col("_total") - 1))
        .filter((F.col("_pos") < F.col("_hi")) & (F.col("_pos") >= F.col("_hi") - F.col("_bn")))
        .withColumn("_pos", F.col("_pos") - (F.col("_hi") - F.col("_bn")))
        .select(*keys, "_b", "p", "_pos")
    )
    inner = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Only buckets that hold a wanted position are sorted.
    ranked = counts.join(wanted.select(*keys, "_b").distinct(), [*keys, "_b"], "left_semi").withColumn("_cum", F.sum("_n").over(inner))
    return (
        ranked.join(wanted, [*keys, "_b"])
        .filter((F.col("_pos") < F.col("_cum")) & (F.col("_pos") >= F.col("_cum") - F.col("_n")))
        .select(*keys, "p", value)
    )


def containment_join(texts: DataFrame, text: str, words: DataFrame, word: str, prefix: int = 4) -> DataFrame:
    """Rows of `texts` joined to rows of `words` whose word occurs in the text, without comparing all pairs.

    Texts are short (labels, titles, ids). A place of the text where a word's first `prefix` characters stand gives one substring
    for every length that words with this beginning have; these substrings (the first time they occur in the text) meet the whole
    words. So only words that are inside are met, however many share a beginning.
    """
    from clausemill.functions import text as tx

    right = stored(words.filter(F.length(word) > 0), "words")
    shapes = right.select(F.substring(word, 1, prefix).alias("__key"), F.length(word).alias("__len")).distinct()
    shapes = stored(shapes.groupBy("__key").agg(F.collect_list("__len").alias("__lens")), "word-shapes")
    sizes = [r.n for r in shapes.select(F.length("__key").alias("n")).distinct().collect()] or [prefix]  # at most `prefix` numbers

    def grams(n: int) -> Column:
        return F.transform(tx.char_ngrams(F.col(text), n), lambda g, i: F.struct((i + 1).alias("at"), g.alias("key")))

    places = texts.withColumn("__g", F.explode(F.concat(*[grams(n) for n in sizes]))).withColumns({"__at": F.col("__g.at"), "__key": F.col("__g.key")}).drop("__g")
    met = checked_join(places, shapes, ["__key"], spread=text).withColumn("__len", F.explode("__lens"))
    met = met.withColumn("__sub", F.col(text).substr(F.col("__at"), F.col("__len"))).filter((F.length("__sub") == F.col("__len")) & (F.position("__sub", text) == F.col("__at")))
    return checked_join(met.select(*texts.columns, "__sub"), right.withColumn("__sub", F.col(word)), ["__sub"], spread=text).drop("__sub")


def star_edges(members: DataFrame, group: list[str], node: str, doc: str | None = None) -> DataFrame:
    """(group, src, dst): links every member of a group to the group's first member instead of to all others.

    The linked components are those of the all-pairs form with a linear number of edges. With `doc`, links stay
    between different documents: members of the first member's document go to the first member of another one.
    """
    if doc is None:
        first = members.groupBy(*group).agg(F.min(node).alias("src"))
        pairs = salted_join(members, first, group, spread=node)
        return pairs.filter(F.col("src") != F.col(node)).select(*group, "src", F.col(node).alias("dst"))
    per_doc = members.groupBy(*group, doc).agg(F.min(node).alias("_n"))
    first = per_doc.groupBy(*group).agg(F.min(F.struct("_n", doc)).alias("_f"))
    second = per_doc.join(first, group).filter(F.col(doc) != F.col("_f")[doc]).groupBy(*group).agg(F.min("_n").alias("_s"))
    both = first.join(second, group)
    pairs = salted_join(members, both, group, spread=node)
    src = F.when(F.col(doc) == F.col("_f")[doc], F.col("_s")).otherwise(F.col("_f")["_n"])
    return pairs.select(*group, src.alias("src"), F.col(node).alias("dst")).select(
        *group, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def runs(batch: pa.RecordBatch, width: int) -> Iterator[tuple[tuple, int, pa.RecordBatch]]:
    """Parts of a sorted batch with equal first `width` columns (numbers) and equal side, the column behind these."""
    if not batch.num_rows:
        return
    cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(width + 1)]
    new = np.zeros(batch.num_rows, bool)
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
    for at, end in zip(cuts, cuts[1:]):
        yield tuple(c[at].item() for c in cols[:-1]), int(cols[-1][at]), batch.slice(at, end - at)
