"""Admission: worked example, plain-Python twin on random input, and agreement of table and stream forms."""

import random
import uuid

from hypothesis import given, settings
from hypothesis import strategies as s
from pyspark.sql import functions as F

from clausemill.functions.scale import checkpoint_root
from clausemill.streaming import operators as so


def naive(times, limit, window):
    kept, out = [], []
    for t in times:
        kept = [x for x in kept if x > t - window]
        ok = len(kept) < limit
        if ok:
            kept.append(t)
        out.append(ok)
    return out


def events(spark, data):
    return spark.createDataFrame(data, "event_id long, sec long, k string").select(
        "event_id", F.timestamp_seconds(F.col("sec") + 1_000_000).alias("ts"), "k")  # a watermark starts at 0, so rows do not


def test_worked_example(spark):
    e = events(spark, [(i, t, "a") for i, t in enumerate([0, 10, 20, 60, 65, 71])])
    got = [r.accepted for r in so.admission_batch(e, "k", 2, 60).orderBy("event_id").collect()]
    assert got == [True, True, False, True, False, True]


@given(s.lists(s.integers(0, 400), min_size=1, max_size=80), s.integers(1, 5), s.integers(1, 90))
@settings(max_examples=200, deadline=None)
def test_decisions_keep_the_limit(times, limit, window):
    times = sorted(times)
    decided, kept = so.admit([float(t) for t in times], [], limit, window)
    flags = [d[0] for d in decided]
    assert flags == naive(times, limit, window) and len(kept) <= limit
    ok = [t for t, f in zip(times, flags) if f]
    assert all(sum(1 for x in ok if t - window < x <= t) <= limit for t in ok)


def test_table_form_on_random_runs(spark):
    rnd = random.Random(5)
    data, want, n = [], {}, 0
    for k in "abcde":
        times = sorted(rnd.choice([rnd.randint(0, 300), rnd.randint(2000, 9000)]) for _ in range(120))
        for t, ok in zip(times, naive(times, 3, 60)):
            data.append((n, t, k))
            want[n] = ok
            n += 1
    got = {r.event_id: r.accepted for r in so.admission_batch(events(spark, data), "k", 3, 60).collect()}
    assert got == want


def test_stream_state_lives_across_batches(spark):
    path = f"{checkpoint_root(spark)}/test-{uuid.uuid4().hex}"
    e = events(spark, [(i, t, "a") for i, t in enumerate([0, 10, 20])])
    e.write.parquet(path)
    src = lambda: spark.readStream.schema(e.schema).parquet(path)
    out = f"{path}-out"

    def once():
        q = so.admission(src(), "k", 2, 60).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
        q.awaitTermination()

    once()
    events(spark, [(i + 3, t, "a") for i, t in enumerate([60, 65, 71])]).write.mode("append").parquet(path)
    once()
    got = [r.accepted for r in spark.read.parquet(out).orderBy("event_id").collect()]
    assert got == [True, True, False, True, False, True]


def test_late_rows_and_state_end(spark):
    """A row behind the watermark is dropped, a late one before it is judged at the key's clock, and state ends."""
    path = f"{checkpoint_root(spark)}/test-{uuid.uuid4().hex}"
    events(spark, [(0, 1000, "a"), (1, 1010, "a"), (2, 5000, "b")]).write.parquet(path)
    src = lambda: spark.readStream.schema("event_id long, ts timestamp, k string").parquet(path)

    def once():
        made = so.admission(src(), "k", 2, 60, watermark="1000 seconds")
        q = made.writeStream.format("parquet").option("path", f"{path}-out").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
        q.awaitTermination()
        return q.lastProgress

    once()
    # 4000 is the watermark: 3000 s is behind it, 4500 s is late for b (clock 5000), and a's state has ended.
    events(spark, [(3, 3000, "a"), (4, 4500, "b"), (5, 5001, "b"), (6, 5002, "a")]).write.mode("append").parquet(path)
    once()
    got = {r.event_id: (r.accepted, r.remaining) for r in spark.read.parquet(f"{path}-out").collect()}
    assert got == {0: (True, 1), 1: (True, 0), 2: (True, 1), 4: (True, 0), 5: (False, 0), 6: (True, 1)}
