"""Transcript parsing: a hidden Markov model recovers who speaks in every line, then turns are rendered in one form."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from clausemill.functions.scale import stored
from clausemill.llm.common import held_out

ROLES = ("system", "user", "assistant")
# Speaker markers of common transcript styles.
MARKERS = {
    "system": "system instruction instructions context".split(),
    "user": "user human question customer q me".split(),
    "assistant": "assistant ai bot answer agent model a gpt".split(),
}
MARKER = re.compile(r"\s*(?:#{1,4}\s*|[<\[(*|]+)?\s*(" + "|".join(w for words in MARKERS.values() for w in words) + r")\s*(?:[>\])*|]+\s*:?|:)[*\s]*", re.I)
SPEAKER = {w: ROLES.index(role) for role, words in MARKERS.items() for w in words}

# A state is a role and whether the line begins a turn of that role or goes on with it: 2 * role + (0 begins, 1 goes on).
STATES = 2 * len(ROLES)
LENGTHS = (20, 60, 120, 240, 480, 960)
FEATURES = (4, len(LENGTHS) + 1, 2, 2, 2, 2)  # marker, length, question, after a blank line, closed sentence before, first line
BLOCK = 256  # parts per block


def features(line: str, before: str | None, blank: bool) -> tuple[int, ...]:
    m = MARKER.match(line)
    body = line[m.end():] if m else line
    length = sum(len(body) > n for n in LENGTHS)
    closed = before is None or before.rstrip()[-1:] in ".!?:;\"'"
    return SPEAKER[m[1].lower()] + 1 if m else 0, length, int("?" in body), int(blank), int(closed), int(before is None)


@dataclass
class Model:
    """Log probabilities: first state, transitions, and one table per feature."""

    first: np.ndarray
    moves: np.ndarray
    emit: list[np.ndarray]

    def seen(self, rows: list[tuple[int, ...]]) -> np.ndarray:
        """(lines, states) log probabilities of what is seen in every line."""
        return sum(table[:, np.array([r[f] for r in rows])] for f, table in enumerate(self.emit)).T

    def across(self, rows: list[tuple[int, ...]]) -> np.ndarray:
        """(states of the first line, states of the last line): weight of the best way between them, without what is seen in the first line."""
        ways = np.where(np.eye(STATES, dtype=bool), 0.0, -math.inf)
        for line in self.seen(rows)[1:]:
            ways = (ways[:, :, None] + self.moves).max(axis=1) + line
        return ways

    def viterbi(self, rows: list[tuple[int, ...]], enter: np.ndarray | None = None, end: int | None = None) -> list[int]:
        """Most probable states of a run of lines, or of its part that is entered with these weights and ends in this state."""
        if not rows:
            return []
        seen = self.seen(rows)
        best, back = self.first + seen[0] if enter is None else enter, []
        for line in seen[1:]:
            ways = best[:, None] + self.moves
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + line
        state = int(best.argmax()) if end is None else end
        out = [state]
        for step in reversed(back):
            state = int(step[state])
            out.append(state)
        return out[::-1]


def prepared(lines: list[str], before: str | None = None, blank: bool = False) -> tuple[list[int], list[tuple[int, ...]]]:
    """(positions, features) of the lines that are not blank. `before`, `blank`: the last such line before them, and whether blank ones follow it."""
    at, rows = [], []
    for i, line in enumerate(lines):
        if not line.strip():
            blank = True
            continue
        at.append(i)
        rows.append(features(line, before, blank))
        before, blank = line, False
    return at, rows


def parse(lines: list[str], model: Model) -> list[tuple[int, int, str]]:
    """(line where it starts, role, text) of every turn; a marker is removed, blank lines inside a turn stay."""
    at, rows = prepared(lines)
    turns: list[tuple[int, int, list[str]]] = []
    for i, state in zip(at, model.viterbi(rows)):
        role, goes_on = divmod(state, 2)
        if goes_on and turns and turns[-1][1] == role:
            own = turns[-1][2]
            own += lines[turns[-1][0] + len(own) : i] + [lines[i]]
        else:
            m = MARKER.match(lines[i])
            turns.append((i, role, [lines[i][m.end():] if m else lines[i]]))
    return [(i, role, "\n".join(own)) for i, role, own in turns]


def render(role: str, text: str) -> str:
    """The canonical form of one turn."""
    return f"<|im_start|>{role}\n{text}<|im_end|>"


def counts_of(turns: list[tuple[int, list[str]]]) -> list[tuple[str, int, int]]:
    """(table, row, column) of every event in a transcript of known turns (role, lines)."""
    lines, states = [], []
    for role, own in turns:
        first = True
        for line in own:
            lines.append(line)
            states.append(2 * role + (0 if first else 1))
            first = first and not line.strip()
    at, rows = prepared(lines)
    events, last = [], None
    for i, row in zip(at, rows):
        state = states[i]
        events.append(("first", 0, state) if last is None else ("move", last, state))
        events += [(f"emit{f}", state, v) for f, v in enumerate(row)]
        last = state
    return events


def model_from(counts: dict[tuple[str, int, int], float], smooth: float = 0.5) -> Model:
    """Relative counts with additive smoothing, little of it for markers, which hardly lie; states that cannot follow each other stay apart."""

    def table(name: str, rows: int, columns: int) -> np.ndarray:
        t = np.full((rows, columns), smooth / 100 if name == "emit0" else smooth)
        for (n, i, j), c in counts.items():
            if n == name:
                t[i, j] += c
        return np.log(t / t.sum(axis=1, keepdims=True))

    first, moves = table("first", 1, STATES)[0], table("move", STATES, STATES)
    first[1::2] = -math.inf
    for a in range(STATES):
        for b in range(1, STATES, 2):
            if a // 2 != b // 2:
                moves[a, b] = -math.inf
    return Model(first, moves, [table(f"emit{f}", STATES, n) for f, n in enumerate(FEATURES)])


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of consecutive rows that agree in the first `keys` columns."""
    key, run = None, []
    for batch in batches:
        names = batch.schema.names
        for row in batch.to_pylist():
            k = tuple(row[c] for c in names[:keys])
            if run and k != key:
                yield key, run
                run = []
            key = k
            run.append(row)
    if run:
        yield key, run


def _blocks(lines: DataFrame) -> DataFrame:
    """Transcript pieces with the number of their block."""
    return lines.withColumn("block", F.floor(F.col("part") / BLOCK).cast("long"))


def learn(turns: DataFrame, modulus: int = 5, held: int = 0) -> Model:
    """Counts events of transcripts with known roles: conv_id, turn, role, text (with its marker, if any). Conversations held out are not read.

    Blocks of a conversation are counted where they are sorted; only the sums, a few hundred numbers, reach the driver.
    """
    known = turns.filter(~held_out(F.col("conv_id"), modulus, held) & F.col("role").isin(*ROLES) & F.col("turn").isNotNull())
    placed = _blocks(known.select("conv_id", F.col("turn").cast("long").alias("part"), "role", F.coalesce("text", F.lit("")).alias("text")))
    dealt = placed.select("conv_id", "block", "part", "role", "text").repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "part", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int, int], int] = {}
        for _, rows in _runs(batches, 2):
            for e in counts_of([(ROLES.index(r["role"]), r["text"].split("\n")) for r in rows]):
                total[e] = total.get(e, 0) + 1
        if total:
            names, i, j = zip(*total)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.values(), pa.int64())], ["t", "i", "j", "n"])

    sums = dealt.mapInArrow(run, "t string, i int, j int, n long").groupBy("t", "i", "j").agg(F.sum("n").alias("n"))
    return model_from({(r.t, r.i, r.j): r.n for r in sums.collect()})


def recover(parts: DataFrame, model: Model) -> DataFrame:
    """conv_id, part, turn, role, text, rendered: the turns found in transcripts.

    `parts`: conv_id, part, text; a transcript is the text of its parts, one after the other, and may mix speaker markers, unmarked
    turns and turns of many lines. Transcripts are parsed in blocks of BLOCK parts, so no task holds the text of a whole conversation.
    Blocks are stitched exactly: their best ways between all states are combined along the conversation, each block is then decoded
    between its own two ends, and the pieces of a turn that crosses blocks are put together. `part` is where a turn starts and `turn` its number in that part (from 0): a part that
    goes on with the turn before it gives no row.
    Null or blank text has no turns. Rows with a null part are left out, a null conv_id is one conversation, repeated rows are read
    one after the other, an empty table gives no rows, and columns not named are ignored.
    """
    lines = parts.select("conv_id", F.col("part").cast("long").alias("part"), F.col("text").cast("string").alias("text")).filter("part IS NOT NULL AND text IS NOT NULL")
    kind, id_type = dict(lines.dtypes)["conv_id"], to_arrow_type(lines.schema["conv_id"].dataType)
    placed = _blocks(lines)
    dealt = placed.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "part", "text").select("conv_id", "block", "text")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, block), rows in _runs(batches, 2):
            yield record([(conv, block, *summary([line for r in rows for line in r["text"].split("\n")], model))], summed)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv,), blocks in _runs(batches, 1):
            found = stitch(blocks, model)
            for at in range(0, len(found), 2000):
                yield record([(conv, *f) for f in found[at : at + 2000]], stitched)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (conv, block), rows in _runs(batches, 2):
            out += [(conv, block, *piece) for piece in pieces(rows[0], rows[1:], model)]
            if len(out) > 2000:
                yield record(out, cut)
                out = []
        if out:
            yield record(out, cut)

    key = [("conv_id", id_type), ("block", pa.int64())]
    summed = pa.schema([*key, ("seen", pa.list_(pa.int32())), ("ways", pa.list_(pa.float64())), ("closed", pa.bool_()), ("blank", pa.bool_())])
    stitched = pa.schema([*key, ("before", pa.string()), ("blank", pa.bool_()), ("enter", pa.list_(pa.float64())), ("end", pa.int32()), ("goes_on", pa.bool_())])
    cut = pa.schema([*key, ("part", pa.int64()), ("turn", pa.int32()), ("role", pa.string()), ("text", pa.string()), ("starts", pa.bool_()), ("whole", pa.bool_())])
    ways = dealt.mapInArrow(sums, f"conv_id {kind}, block long, seen array<int>, ways array<double>, closed boolean, blank boolean")
    ways = ways.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    context = ways.mapInArrow(ends, f"conv_id {kind}, block long, before string, blank boolean, enter array<double>, end int, goes_on boolean")
    both = placed.unionByName(context, allowMissingColumns=True).repartition("conv_id", "block")
    both = both.sortWithinPartitions("conv_id", "block", F.col("goes_on").isNull(), "part", "text")  # a block's context comes first
    both = both.select("conv_id", "block", "part", "text", "before", "blank", "enter", "end", "goes_on")
    cuts = stored(both.mapInArrow(decode, f"conv_id {kind}, block long, part long, turn int, role string, text string, starts boolean, whole boolean"), "turns")

    order = Window.partitionBy("conv_id").orderBy("block", "starts")
    numbered = cuts.filter("NOT whole").withColumn("n", F.sum(F.col("starts").cast("long")).over(order))
    first = [F.max(F.when(F.col("starts"), F.col(c))).alias(c) for c in ("part", "turn", "role")]
    texts = F.sort_array(F.collect_list(F.struct("block", "starts", "text")))
    joined = numbered.groupBy("conv_id", "n").agg(*first, F.array_join(F.transform(texts, lambda t: t["text"]), "\n").alias("text")).drop("n")
    every = cuts.filter("whole").select("conv_id", "part", "turn", "role", "text").union(joined.select("conv_id", "part", "turn", "role", "text"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["conv_id"], r["part"], r["turn"], r["role"], t := r["text"].strip(), render(r["role"], t)) for r in batch.to_pylist()]
            if rows:
                yield batch_of(rows, id_type)

    return every.mapInArrow(finish, f"conv_id {kind}, part long, turn int, role string, text string, rendered string")


def record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def summary(lines: list[str], model: Model) -> tuple:
    """Of a block: features of its first line (as if nothing came before), best ways through it, whether the last line is closed and whether blank ones follow."""
    at, rows = prepared(lines)
    if not at:
        return None, None, None, True
    closed = bool(features("", lines[at[-1]], False)[4])
    return list(rows[0]), model.across(rows).ravel().tolist(), closed, at[-1] < len(lines) - 1


def stitch(blocks: list[dict], model: Model) -> list[tuple]:
    """(block, line before, blank, enter, end, goes_on) of the blocks of a conversation, in order.

    `before` stands for the last line before the block (null, "." closed, "a" not closed), `blank` tells whether blank ones follow it,
    `enter` are the weights of the first line's states, `end` is the last line's state, and `goes_on` tells whether the turn that is
    open at the end goes on after the block.
    """
    before, blank, best = None, False, None
    held = []
    for b in blocks:
        enter = back = through = None
        if b["seen"]:
            row = list(b["seen"])
            row[3:] = int(blank or row[3]), int(before in (None, ".")), int(before is None)
            seen = model.seen([tuple(row)])[0]
            if best is None:
                enter = model.first + seen
            else:
                moved = best[:, None] + model.moves
                back, enter = moved.argmax(axis=0), moved.max(axis=0) + seen
            enter = enter - enter.max()  # only differences count
            ways = enter[:, None] + np.array(b["ways"]).reshape(STATES, STATES)
            through, best = ways.argmax(axis=0), ways.max(axis=0)
        held.append((b["block"], before, blank, enter, back, through))
        if b["seen"]:
            before, blank = "." if b["closed"] else "a", b["blank"]
        else:
            blank = True
    out, end, goes_on = [], None if best is None else int(best.argmax()), False
    for block, before, blank, enter, back, through in reversed(held):
        if enter is None:
            out.append((block, before, blank, None, None, goes_on))
            continue
        out.append((block, before, blank, enter.tolist(), end, goes_on))
        start = int(through[end])
        goes_on = back is not None and start % 2 == 1
        end = int(back[start]) if back is not None else None
    return out[::-1]


def pieces(context: dict, rows: list[dict], model: Model) -> list[tuple]:
    """(part, turn, role, text, starts, whole) of the turns that start in a block, and of the one that goes on into it."""
    lines, owner = [], []
    for row in rows:
        own = row["text"].split("\n")
        lines += own
        owner += [row["part"]] * len(own)
    at, seen = prepared(lines, context["before"], context["blank"])
    enter = None if context["enter"] is None else np.array(context["enter"])
    states = model.viterbi(seen, enter, context["end"])
    head = context["goes_on"] and context["before"] is not None if not at else context["before"] is not None and states[0] % 2 == 1
    starts = []  # (line, role)
    for i, state in zip(at, states):
        role, goes_on = divmod(state, 2)
        if not (goes_on and (starts[-1][1] == role if starts else head)):
            starts.append((i, role))
    out = []
    if head:
        out.append((None, None, None, "\n".join(lines[: starts[0][0] if starts else len(lines)]), False, False))
    number: dict[int, int] = {}
    for k, (i, role) in enumerate(starts):
        part = owner[i]
        number[part] = n = number.get(part, -1) + 1
        m = MARKER.match(lines[i])
        last = k + 1 == len(starts)
        own = [lines[i][m.end():] if m else lines[i], *lines[i + 1 : len(lines) if last else starts[k + 1][0]]]
        out.append((part, n, ROLES[role], "\n".join(own), True, not (last and context["goes_on"])))
    return out


def batch_of(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    conv, part, turn, role, text, rendered = zip(*rows)
    arrays = [pa.array(conv, id_type), pa.array(part, pa.int64()), pa.array(turn, pa.int32()), pa.array(role), pa.array(text), pa.array(rendered)]
    return pa.RecordBatch.from_arrays(arrays, ["conv_id", "part", "turn", "role", "text", "rendered"])


STYLES = (("System: ", "User: ", "Assistant: "), ("### Instruction: ", "### Human: ", "### Assistant: "), ("[system] ", "[Q] ", "[A] "))


def as_transcript(turns: DataFrame) -> DataFrame:
    """conv_id, part, role, text of raw transcripts made from a table of turns: a marker style per conversation, every fifth turn unmarked,
    a blank line before unmarked turns."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    unmarked = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5)) == 0
    marks = F.array(*[F.array(*[F.lit(m) for m in s]) for s in STYLES])
    role = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role")).cast("int") - 1
    mark = F.when(unmarked, "\n").otherwise(F.coalesce(F.get(F.get(marks, style), role), F.lit("\n")))
    return turns.select("conv_id", F.col("turn").cast("long").alias("part"), "role", F.concat(mark, F.coalesce(F.col("text"), F.lit(""))).alias("text"))
