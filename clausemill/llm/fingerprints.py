"""Order MinHash fingerprints, in DataFrame functions only.

A text's tokens give k-mers, each numbered by its occurrence. Hash values are dealt into SLOTS ranges (one permutation, many
slots); each slot takes the TUPLE smallest of its range, puts them back into text order and hashes them. Two texts agree on a slot
when the same k-mers are smallest there and stand in the same order, which is what a small edit distance leaves in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = r"\S{1,16}"  # a longer run is cut, so scripts without spaces have k-mers too
K = 3
SLOT_BITS = 6
TUPLE = 2
POSITION_BITS = 24  # text order is kept modulo 2^24 tokens
HASH_BITS = 26


def at(array: str, index: Column) -> Column:
    return F.get(F.col(array), index)


def upto(n: Column) -> Column:
    """0 .. n-1 as an array, empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def kmer(high: Column) -> Column:
    """The hash part of a packed value."""
    return F.shiftright(high, POSITION_BITS)


def packed(value: Column, position: Column) -> Column:
    """Upper bits of the hash over the position, so that sorting plain longs sorts by hash, then by position."""
    mask = (1 << POSITION_BITS) - 1
    return value.bitwiseAND(F.lit(~mask)).bitwiseOR(position.cast("long").bitwiseAND(F.lit(mask)))


def with_codes(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds `out`: one number per filled slot (slot above HASH_BITS, tuple hash below), in slot order.

    Steps are columns of their own because a lambda would evaluate an inlined array once per element.
    """
    keep = df.columns
    mask = (1 << POSITION_BITS) - 1
    df = df.select(*keep, F.transform(F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t)).alias("__h"))
    n = F.size("__h")
    grams = F.transform(upto(n - (K - 1)), lambda i: packed(F.xxhash64(*[at("__h", i + d) for d in range(K)]), i))
    short = F.when(n > 0, F.array(packed(F.xxhash64("__h"), F.lit(0)))).otherwise(F.array().cast("array<long>"))
    df = df.select(*keep, F.sort_array(F.when(n >= K, grams).otherwise(short)).alias("__p"))
    first = F.filter(upto(F.size("__p")), lambda j: (j == 0) | (kmer(at("__p", j)) != kmer(at("__p", j - 1))))
    df = df.select(*keep, "__p", first.alias("__s"))

    def numbered(start: Column, run: Column) -> Column:
        end = F.coalesce(F.get("__s", run + 1), F.size("__p"))
        again = F.transform(
            F.sequence(start, end - 1),
            lambda j: F.when(j == start, at("__p", j)).otherwise(
                packed(F.xxhash64(kmer(at("__p", j)), j - start), at("__p", j).bitwiseAND(F.lit(mask)))),
        )
        return F.when(end - start == 1, F.array(at("__p", start))).otherwise(again)

    df = df.select(*keep, F.sort_array(F.flatten(F.transform("__s", numbered))).alias("__q"))
    slot = lambda j: F.shiftright(at("__q", j), 64 - SLOT_BITS)
    heads = F.filter(upto(F.size("__q")), lambda j: (j == 0) | (slot(j) != slot(j - 1)))
    df = df.select(*keep, "__q", heads.alias("__b"))

    def code(j: Column) -> Column:
        a, b = at("__q", j), at("__q", j + 1)
        in_order = a.bitwiseAND(F.lit(mask)) <= b.bitwiseAND(F.lit(mask))
        both = F.when(in_order, F.xxhash64(kmer(a), kmer(b))).otherwise(F.xxhash64(kmer(b), kmer(a)))
        hashed = F.when(slot(j) == slot(j + 1), both).otherwise(F.xxhash64(kmer(a)))
        return F.shiftleft(slot(j) + (1 << (SLOT_BITS - 1)), HASH_BITS).bitwiseOR(hashed.bitwiseAND(F.lit((1 << HASH_BITS) - 1)))

    return df.select(*keep, F.transform("__b", code).alias(out))


def told(codes: str) -> Column:
    return F.array_join(F.transform(codes, lambda c: F.hex(c)), "-")


def likeness(a: str, b: str) -> Column:
    """Share of the slots filled in either that agree; 1 for two texts without tokens."""
    slots = lambda c: F.transform(c, lambda x: F.shiftright(x, HASH_BITS))
    union = F.size(a) + F.size(b) - F.size(F.array_intersect(slots(a), slots(b)))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def with_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """`docs` (id, text) with `part`, consecutive id ranges of similar size, and `guest`.

    The first rows of a range also go to the range before it (the very first to the last), as guests, so every row finds its
    successor within its range. Borders and first ids are `ranges` numbers each. Null ids form the last range.
    """
    cuts = docs.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 10_000)).first()[0] if ranges > 1 else []
    borders = sorted(set(cuts or []))
    thresholds = F.array(*[F.lit(b) for b in borders]).cast("array<long>")
    powers = F.array(*[F.lit(1 << i) for i in reversed(range(len(borders).bit_length()))]).cast("array<int>")

    def step(low: Column, width: Column) -> Column:  # binary search: how many borders lie below the id
        return F.when(F.get(thresholds, low + width - 1) < F.col("id"), low + width).otherwise(low)

    part = F.when(F.col("id").isNull(), len(borders) + 1).otherwise(F.aggregate(powers, F.lit(0), step) if borders else F.lit(0))
    placed = docs.withColumn("part", part)
    firsts = dict(placed.groupBy("part").agg(F.min("id")).collect())
    order = sorted(firsts)
    before = {p: order[i - 1] for i, p in enumerate(order)}
    size = len(borders) + 2
    first_id = F.get(F.array(*[F.lit(firsts.get(p)).cast("long") for p in range(size)]), F.col("part"))
    target = F.get(F.array(*[F.lit(before.get(p, 0)) for p in range(size)]), F.col("part"))
    own, sent = F.struct(F.col("part").alias("part"), F.lit(0).alias("guest")), F.struct(target.alias("part"), F.lit(1).alias("guest"))
    places = F.when(F.col("id").eqNullSafe(first_id), F.array(own, sent)).otherwise(F.array(own))
    return placed.select("id", "text", F.explode(places).alias("place")).select("id", "text", "place.part", "place.guest")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document's;
    next is by ascending doc_id, nulls last, ties by text, and the first follows the last. Null text counts as empty and has the
    fingerprint ''. Repeated rows are repeated (one is the next of the other). An empty table gives no rows. Columns other than
    the two named are ignored. Texts are shuffled once, by id range.
    """
    n = ranges or 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    row = Window.partitionBy("part").orderBy("guest", F.col("id").asc_nulls_last(), "text")
    placed = with_ranges(picked, n).withColumn("follower", F.lead("text").over(row))
    chars, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), chars - half), F.substring(F.coalesce("follower", F.lit("")), F.lit(1), half))
    placed = with_codes(placed.withColumn("edited", edited), "text", "codes").withColumn("next_codes", F.lead("codes").over(row))
    own = with_codes(placed.filter("guest = 0"), "edited", "edited_codes")
    return own.select(
        F.col("id").alias("doc_id"), chars.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        told("codes").alias("fingerprint"), told("edited_codes").alias("edited_fingerprint"),
        likeness("codes", "edited_codes").alias("near_edited"), likeness("codes", "next_codes").alias("near_next"))
