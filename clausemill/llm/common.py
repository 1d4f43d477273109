"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


def utf8_size(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def by_bytes(texts: Iterable[str], most: int) -> Iterator[list[str]]:
    """Runs of consecutive texts of about `most` UTF-8 bytes in all; a longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        n = utf8_size(t)
        if run and size + n > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += n
    if run:
        yield run


BATCH_ROWS = 1_000  # whole texts that go to a Python worker at once, at most


def small_batches(spark: SparkSession) -> SparkSession:
    """Lets at most BATCH_ROWS rows go to a Python worker at once: both sides hold a batch whole, the worker as strings too."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


_memos: dict[str, dict] = {}


def memo_of(step: str) -> dict:
    """What a step keeps in its Python worker from task to task. Workers serve one step after the other: what others left is dropped."""
    if step not in _memos:
        _memos.clear()
        pa.default_memory_pool().release_unused()
        _memos[step] = {}
    return _memos[step]


LARGEST = 1 << 26  # components are held within this on both sides, so sums of 2,048 squares fit 64 bits


def whole_vectors(column: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the lists of exactly `width` numbers, none null or non-finite, and a matrix of floor(256 x)."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
    places = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    flat = column.filter(fits).flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False).reshape(len(places), width)  # nulls become NaN
    good = np.isfinite(values).all(axis=1)
    return places[good], np.clip(np.floor(values[good] * 256), -LARGEST, LARGEST).astype(np.int64)


def trim(memo: dict, most: int) -> None:
    """Forgets everything once a memo holds more than `most` entries, so a worker's memory stays bounded."""
    if len(memo) > most:
        memo.clear()


def held_out(doc_id: Column, modulus: int, held: int) -> Column:
    """Whether crc32 of the id's decimal text leaves remainder `held`; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == held, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, most: dict[int, int],
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, label, weight of labelled documents outside the held-out rows, about `most[label]` per label.

    Rows are chosen by a hash of the id; weight restores the labels' shares. The chosen ids are so few that they are broadcast.
    """
    own = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("label")).dropna()
    own = own.filter(~held_out(F.col("id"), modulus, held)).groupBy("id").agg(F.max("label").alias("label"))
    shares = {r.label: r.n for r in own.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    scale = 1 << 30
    keep, weight = F.lit(False), F.lit(1.0)
    for value, n in shares.items():
        part = min(1.0, most.get(value, 0) / n)
        if part:
            keep = keep | ((F.col("label") == value) & (F.pmod(F.xxhash64("id"), F.lit(scale)) < int(part * scale)))
            weight = F.when(F.col("label") == value, 1 / part).otherwise(weight)
    ids = own.filter(keep).withColumn("weight", weight)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids), "id")
