"""Fingerprints against a plain restatement of the method."""

import hashlib
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from clausemill.llm import fingerprints as fp

SF = "/root/testdata/sf0.001"


def x64(*values):
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<q", v) if not isinstance(v, Int) else struct.pack("<i", v)
        seed = xxhash.xxh64_intdigest(data, seed) if not isinstance(v, Int) else xx_int(v, seed)
    return seed - (1 << 64) if seed >> 63 else seed


class Int(int):
    pass


def xx_int(v, seed):
    return xxhash.xxh64_intdigest(struct.pack("<i", v), seed)


def plain_codes(text):
    hashes = [x64(t) for t in re.findall(r"\S{1,16}", text)]
    mask = (1 << 24) - 1
    if len(hashes) >= 3:
        grams = [(x64(*hashes[i : i + 3]) & ~mask, i) for i in range(len(hashes) - 2)]
    elif hashes:
        grams = [(x64(*hashes) & ~mask, 0)]
    else:
        grams = []
    seen, numbered = {}, []
    for h, i in grams:
        o = seen[h] = seen.get(h, -1) + 1
        numbered.append((h if not o else x64(h >> 24, Int(o)) & ~mask, i))
    codes = []
    for slot in range(-32, 32):
        own = sorted(x for x in numbered if x[0] >> 58 == slot)[:2]
        if own:
            h = x64(*[a >> 24 for a, _ in sorted(own, key=lambda x: x[1])])
            codes.append((slot + 32) << 26 | h & ((1 << 26) - 1))
    return codes


def plain_likeness(a, b):
    slots = {x >> 26 for x in a} | {x >> 26 for x in b}
    return len(set(a) & set(b)) / len(slots) if slots else 1.0


def plain(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode()))
    out = []
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        t, u = t or "", u or ""
        half = len(t) // 2
        e = t[: len(t) - half] + u[:half]
        a, b, c = map(plain_codes, (t, e, u))
        told = ["-".join(f"{x:X}" for x in y) for y in (a, b)]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), *told, plain_likeness(a, b), plain_likeness(a, c)))
    return sorted(out, key=str)


@pytest.mark.parametrize("ranges", [1, 2, 7, 40])
def test_fingerprint(spark, odd, none, ranges):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(80)
    df = odd.select("doc_id", "text").unionByName(docs).withColumn("id", F.lit("clash")).withColumn("part", F.lit(1)).cache()
    got = fp.fingerprint(df, ranges=ranges).collect()
    assert sorted(map(tuple, got), key=str) == plain([(r.doc_id, r.text) for r in df.collect()])
    assert fp.fingerprint(none, ranges=ranges).count() == 0


def test_single(spark):
    got = fp.fingerprint(spark.createDataFrame([(7, "a b c d e f g h")], "doc_id long, text string")).collect()
    assert got[0].near_next == 1.0 and got[0].doc_id == 7


def test_order_counts(spark):
    words = [f"w{i}" for i in range(60)]
    swapped = words[30:] + words[:30]
    rows = [(1, " ".join(words)), (2, " ".join(words[:20] + ["x"] + words[20:])), (3, " ".join(swapped))]
    df = fp.with_codes(spark.createDataFrame(rows, "id long, text string"), "text", "codes")
    c = {r.id: r.codes for r in df.collect()}
    assert plain_likeness(c[1], c[2]) > 0.75 and plain_likeness(c[1], c[2]) > plain_likeness(c[1], c[3])
