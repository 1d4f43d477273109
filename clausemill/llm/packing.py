"""Best-fit packing of tokenised documents into fixed-length sequences by the sum-of-squares rule."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.functions.scale import stored
from clausemill.llm.common import memo_of, texts_of, trim

# One run of letters with fixed composition and case mapping, then marks that the tokenizer keeps together.
SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:]*)")
MEMO_ENTRIES = 600_000


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes.

    The tokenizer drops white space and never joins characters across it, so a text's ids are those of its space-separated
    parts in order. Parts repeat, so each is encoded once and remembered. Parts of plain letters and marks go straight to the
    tokenizer's model; all others take its full path.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        letters = [chr(c) for c in range(0x41, 0x100) if SIMPLE.fullmatch(chr(c))]
        mapped = {c: "".join(s for s, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(c)) for c in letters}
        self.letters = str.maketrans(mapped)  # plain letters stay as they are
        self.parts, self.words, self.marks = {"": b""}, {}, {"": b""}

    def full(self, part: str) -> bytes:
        return np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u4").tobytes()

    def part(self, part: str) -> bytes:
        m = SIMPLE.fullmatch(part)
        if not m:
            return self.full(part)
        word, marks = m[1].lower(), m[2]
        ids = self.words.get(word)
        if ids is None:
            tokens = self.model.tokenize(word if word.isascii() else word.translate(self.letters))
            ids = self.words[word] = array("I", [t.id for t in tokens]).tobytes()
        if marks and marks not in self.marks:
            if len(marks) > 8:
                return ids + self.full(marks)
            self.marks[marks] = self.full(marks)
        return ids + self.marks[marks]

    def encode(self, text: str) -> bytes:
        parts, seen = text.replace("\n", " ").split(" "), self.parts  # translate() takes a fifth of all time on texts beyond ASCII
        ids = list(map(seen.get, parts))
        if None in ids:
            for at in [i for i, known in enumerate(ids) if known is None]:
                p = parts[at]
                ids[at] = one = seen.get(p) or self.part(p)
                if len(p) <= 64:
                    seen[p] = one
            trim(seen, MEMO_ENTRIES)
            trim(self.words, MEMO_ENTRIES)
        return b"".join(ids)


def encoder(path: str) -> Encoder:
    own = memo_of("packing")
    if path not in own:
        own[path] = Encoder(path)
    return own[path]


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every item, taken longest first, each put where the sum of squared counts of open bins per gap is least.

    Opening a bin is one of the choices; on equal sums an open bin wins, then the smaller gap.
    """
    counts = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    opened = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        gap = capacity
        if size < capacity:
            left = counts[: capacity - size + 1] * 2 + 1
            left[0] = 0  # a full bin is no longer open
            change = left[: capacity - size] - 2 * counts[size:capacity] + 1
            change[counts[size:capacity] == 0] = np.iinfo(np.int64).max
            best = int(np.argmin(change)) if len(change) else -1
            if best >= 0 and change[best] <= left[capacity - size]:
                gap = size + best
        if gap == capacity:
            b = opened
            opened += 1
        else:
            b = stacks[gap].pop()
            counts[gap] -= 1
        bins[i], offsets[i] = b, capacity - gap
        if gap - size:
            stacks[gap - size].append(b)
            counts[gap - size] += 1
    return bins, offsets


OUT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
GROUP_ROWS = 50_000  # pieces that one task of a later round packs, about
ROUNDS = 4


def repack(open_pieces: DataFrame, groups: int, level: int, capacity: int) -> DataFrame:
    """Packs the pieces of open sequences anew, in `groups` groups dealt by a hash of their place."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        bins, offsets = sum_of_squares(rows["length"].to_numpy(), capacity)
        base = (level << 58) + (rows["part"][0].as_py() << 33)
        used = np.bincount(bins, rows["length"].to_numpy()).astype(np.int64)
        new = {"sequence_id": base + bins, "offset": offsets, "room": capacity - used[bins]}
        return pa.table({c: pa.chunked_array([pa.array(new[c])]) if c in new else rows[c] for c in rows.column_names if c != "part"})

    part = F.pmod(F.xxhash64("sequence_id", "offset"), F.lit(groups))
    return open_pieces.withColumn("part", part).groupBy("part").applyInArrow(run, f"{OUT}, room long")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0,
         group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most `capacity` tokens.

    A document's ids end with `end_id`; only longer ones are cut, into pieces of `capacity`. Each scan split is tokenised and
    packed where it is read; the pieces, without texts or ids, are written to the shared folder. Sequences with more than 1/512 of
    their room left stay open: their pieces are dealt into groups of about `group_rows` and packed again, and what these leave
    open once more, until one group held all that was open (ROUNDS rounds at most). So the number of sequences hardly depends on
    the splits, and a task holds the few numbers of its pieces.
    Null or empty text: the one piece that holds `end_id`. Null ids and repeated rows are packed as they come. An empty table gives
    no rows. Columns other than the two named are ignored. `tokenizer` is the path of a tokenizer file on the workers.
    Output: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), int(end_id).to_bytes(4, "little")
        step = 4 * capacity
        ids: list[pa.Array] = []
        row_of, piece, start, length, crc = array("q"), array("i"), array("q"), array("q"), array("q")
        rows = 0
        for batch in batches:
            ids.append(batch.column(0))
            for k, text in enumerate(texts_of(batch.column(1))):
                data = enc.encode(text) + end
                for n, at in enumerate(range(0, len(data), step)):
                    cut = data[at : at + step]
                    row_of.append(rows + k)
                    piece.append(n)
                    start.append(at // 4)
                    length.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
            rows += batch.num_rows
        if not rows:
            return
        lengths = np.array(length, np.int64)
        bins, offsets = sum_of_squares(lengths, capacity)
        used = np.bincount(bins, lengths).astype(np.int64)
        doc = pa.chunked_array(ids).take(pa.array(np.array(row_of, np.int64)))
        base = TaskContext.get().partitionId() << 33
        out = pa.table({"doc_id": doc.cast(pa.int64()), "piece": pa.array(np.array(piece, np.int32)), "start": np.array(start, np.int64),
                        "length": lengths, "ids_crc32": np.array(crc, np.int64), "sequence_id": base + bins, "offset": offsets,
                        "room": capacity - used[bins]})
        yield from out.to_batches(50_000)

    packed = stored(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, f"{OUT}, room long"), "packing")
    is_open = F.col("room") > capacity // 512
    closed = packed.filter(~is_open)
    for level in range(1, ROUNDS + 1):
        loose = packed.filter(is_open)
        groups = -(-loose.count() // group_rows)
        if not groups:
            break
        packed = repack(loose, groups, level, capacity)
        if groups == 1 or level == ROUNDS:
            closed = closed.unionByName(packed)
            break
        packed = stored(packed, "packing")
        closed = closed.unionByName(packed.filter(~is_open))
    return closed.drop("room")
