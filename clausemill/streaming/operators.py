"""Streaming operators (W1-W5). Watermark: 10 minutes by default, later rows are dropped."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clausemill.functions.scale import stored_root
from clausemill.operators.terms import query_signature

WATERMARK = "10 minutes"
ADMISSION = "key string, event_id long, ts timestamp, accepted boolean, remaining long, reset_in double"


def admit(times: list[float], accepted: list[float], limit: int, window: float) -> tuple[list[tuple[bool, int, float]], list[float]]:
    """Decisions for times in order, given the accepted times so far. At most `limit` times are kept."""
    out = []
    for now in times:
        accepted = [x for x in accepted if x > now - window]
        ok = len(accepted) < limit
        if ok:
            accepted.append(now)
        out.append((ok, limit - len(accepted), accepted[0] + window - now if accepted else 0.0))
    return out, accepted


def admission(stream: DataFrame, key: str, limit: int = 60, window: float = 60.0, watermark: str = WATERMARK) -> DataFrame:
    """Accept a key's event if fewer than `limit` accepted ones lie within the window; refused ones do not count.

    Rows behind the watermark are dropped. A late row before it is judged at the latest time its key has seen, as a clock that
    never goes back. State per key is that time and at most `limit` accepted times; it ends when the watermark is a window
    past the last event. In a micro-batch a key's rows are held as two numbers each, to put them in order; the trigger's
    options (such as maxFilesPerTrigger) bound a micro-batch. stream(event_id, ts, key).
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parts = [(pdf["ts"].astype("datetime64[us]").astype("int64").to_numpy(), pdf["event_id"].to_numpy()) for pdf in batches]
        micros, ids = (np.concatenate(p) for p in zip(*parts))
        order = np.lexsort((ids, micros))
        latest, kept = (state.get[0], list(state.get[1])) if state.exists else (-math.inf, [])
        clock = np.maximum(np.maximum.accumulate(micros[order] / 1e6), latest)
        decided, kept = admit(clock.tolist(), kept, limit, window)
        state.update((float(clock[-1]), kept))
        state.setTimeoutTimestamp(int((clock[-1] + window) * 1000) + 1)
        yield pd.DataFrame({
            "key": k[0], "event_id": ids[order], "ts": micros[order].astype("datetime64[us]"), "accepted": [d[0] for d in decided],
            "remaining": [d[1] for d in decided], "reset_in": [d[2] for d in decided]})

    keyed = stream.select(F.col(key).cast("string").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", watermark)
    return keyed.groupBy("key").applyInPandasWithState(step, ADMISSION, "latest double, accepted array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def admission_batch(events: DataFrame, key: str, limit: int = 60, window: int = 60) -> DataFrame:
    """W1 over a table, exact. events(event_id, ts, key) -> (key, event_id, accepted).

    Time is cut into steps of one window. A run of non-empty steps is independent of the other runs of its key, and a
    run in which no two neighbouring steps hold more than `limit` events is accepted whole, by built-in expressions.
    Only crowded runs are decided in order, streamed in sorted batches with at most `limit` times in memory.
    """
    secs = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.select(F.col(key).cast("string").alias("key"), "event_id", secs.alias("us")).withColumn("step", F.floor(F.col("us") / (window * 1000000)))
    w = Window.partitionBy("key").orderBy("step")
    steps = rows.groupBy("key", "step").agg(F.count("*").alias("n"))
    prev = F.lag("step").over(w)
    marked = steps.withColumns({"first": F.when(prev == F.col("step") - 1, 0).otherwise(1), "pair": F.col("n") + F.when(prev == F.col("step") - 1, F.lag("n").over(w)).otherwise(0)})
    runs = marked.withColumn("run", F.sum("first").over(w))
    busy = runs.groupBy("key", "run").agg((F.max("pair") > limit).alias("busy"))
    placed = rows.join(runs.select("key", "step", "run").join(busy, ["key", "run"]), ["key", "step"])
    free = placed.filter("not busy").select("key", "event_id", F.lit(True).alias("accepted"))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, kept = None, []
        for pdf in batches:
            flags = []
            for k, r, us in zip(pdf["key"], pdf["run"], pdf["us"]):
                if (k, r) != at:
                    at, kept = (k, r), []
                decided, kept = admit([us / 1e6], kept, limit, window)
                flags.append(decided[0][0])
            yield pd.DataFrame({"key": pdf["key"], "event_id": pdf["event_id"], "accepted": flags})

    crowded = placed.filter("busy").repartition("key", "run").sortWithinPartitions("key", "run", "us", "event_id")
    return free.unionByName(crowded.select("key", "run", "us", "event_id").mapInPandas(decide, "key string, event_id long, accepted boolean"))


def rolling_metrics(stream: DataFrame, key: str, value: str, size: str = "1 day", watermark: str = WATERMARK) -> DataFrame:
    """W2 by event time: count, mean and extremes per key and window; state ends with the watermark."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", watermark).groupBy(F.window("ts", size), key).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("highest")).select(
        F.col("window.start").alias("start"), key, "n", "mean", "highest")


def last_n_metrics(stream: DataFrame, key: str, value: str, n: int = 1000) -> DataFrame:
    """W2 by rows: total count and the mean of the last n values per key, emitted after each micro-batch.

    The total counts for ever, so state stays: n values per key. A key's rows pass through one task, which holds n of them.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, kept = (state.get[0], list(state.get[1])) if state.exists else (0, [])
        # Keep a bounded tail while reading: (time, id, value) of the newest n rows of this batch.
        tail: list[tuple] = []
        for pdf in batches:
            total += len(pdf)
            part = pdf.nlargest(n, ["ts", "event_id"]) if len(pdf) > n else pdf
            tail = sorted([*tail, *zip(part["ts"], part["event_id"], part["v"])])[-n:]
        kept = (kept + [float(x[2]) for x in tail])[-n:]
        state.update((total, kept))
        yield pd.DataFrame({"key": [k[0]], "n": [total], "mean": [sum(kept) / len(kept) if kept else 0.0]})

    rows = stream.select(F.col(key).cast("string").alias("key"), "event_id", "ts", F.col(value).alias("v"))
    return rows.groupBy("key").applyInPandasWithState(step, "key string, n long, mean double", "total long, last array<double>", "update", GroupStateTimeout.NoTimeout)


def feedback(stream: DataFrame, query: str, value: str) -> DataFrame:
    """Latest feedback and number of feedbacks per query signature (update mode).

    The state is the answer: three values for every signature ever seen. A signature has no end, so there is no watermark.
    """
    return stream.withColumn("signature", query_signature(F.col(query))).groupBy("signature").agg(
        F.max_by(value, F.struct("ts", "event_id")).alias("last_value"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


def detect_new_files(spark: SparkSession, path: str, glob: str = "*", watermark: str = WATERMARK) -> DataFrame:
    """Stream of newly arrived files (path, stem, modified); the content is not read."""
    listing = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(listing).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("stem"), F.col("modificationTime").alias("modified")).withWatermark(
        "modified", watermark).dropDuplicatesWithinWatermark(["path"])


def upsert_chunks(stream: DataFrame, path: str, checkpoint: str, id: str = "chunk_id") -> None:
    """Every micro-batch is deduplicated (first per id) and written as one version; a repeated batch overwrites its
    own version, so a restart changes nothing. `current_chunks` merges versions, the last write wins."""

    def write(batch: DataFrame, n: int) -> None:
        rest = [c for c in batch.columns if c != id]
        first = batch.groupBy(id).agg(F.min_by(F.struct(*rest), "seq").alias("r")).select(id, "r.*")
        first.write.mode("overwrite").parquet(f"{path}/version={n}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def current_chunks(spark: SparkSession, path: str, id: str = "chunk_id") -> DataFrame:
    """Latest version of every chunk (partial aggregation first, then one row per id)."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (id, "version")]
    return rows.groupBy(id).agg(F.max_by(F.struct(*rest), "version").alias("r")).select(id, "r.*")


def run_to_table(stream: DataFrame, name: str, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over what is available and returns its output table; with keys, the last row per key.

    Output and checkpoint lie in the shared checkpoint folder, one new folder per run.
    """
    import uuid

    spark = stream.sparkSession
    root = f"{stored_root(spark)}/streams/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={n}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{root}/out")
    if keys is None:
        return rows.drop("batch")
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
