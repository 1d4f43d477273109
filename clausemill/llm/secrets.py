"""Secret scan: fixed patterns, and a guess-cost rule for values that stand in a credential context.

Words are ranked by how common they are: first those that people put into passwords, then by turns those of a public vocabulary
file and those that the documents themselves use most.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, zip_longest

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.functions.scale import stored
from clausemill.llm.common import memo_of, texts_of, trim

MEMO_ENTRIES = 50_000
MEMO_CHARS = 256  # longer values are not remembered
HEAD = 256  # so many characters of a long value are scored first
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.A)
HEX = re.compile(r"[0-9a-f]{32,}", re.A)
# Names that announce a credential beyond the fixed patterns, what may follow them (also a scheme word), and the value.
CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|credentials?|auth(?:orization)?|bearer|api[ _-]?key|"""
    r"""(?:access|private|secret|client|signing)[ _-]?(?:key|secret|token))["'`]?\x20*(?::=|=>|[:=]|\x20(is|was)\x20)\x20*["'`]?(?:(?:bearer|basic|token|negotiate|apikey)\x20+)?([^\s"'`<>,;]{4,})""",
    re.I | re.A)
PROSE = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*[.!?):]*")  # a plain word
PLACE = re.compile(r"[a-z][a-z0-9+.-]*://[^/?#@]*(?:[/?#]|$)", re.I)  # an address without user and password
HINTS = ("pass", "pwd", "pin", "secret", "token", "credential", "auth", "bearer", "key")

# Words that people put into passwords, by rank of use.
COMMON = (
    "password pass admin login welcome master secret dragon monkey shadow sunshine princess football baseball letmein love "
    "hello test user guest root changeme default summer winter spring autumn money super star king queen tiger lion eagle "
    "angel flower cookie pepper ginger computer internet server system access private public token example sample none null "
    "true false string value your here the and this that with from key"
).split()
RANKED_WORDS, RANKED_DOCUMENTS = 30_000, 5  # words taken from the documents, at most; documents that use such a word, at least
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SEQUENCES = ("abcdefghijklmnopqrstuvwxyz", "0123456789")
DATES = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")
LEET = str.maketrans("013457$@", "oleastsa")

STEPS: dict[str, set[str]] = {}
for row in ROWS:
    for left, right in zip(row, row[1:]):
        STEPS.setdefault(left, set()).add(right)
        STEPS.setdefault(right, set()).add(left)
for upper, lower in zip(ROWS, ROWS[1:]):
    for i, c in enumerate(lower):
        for other in upper[i : i + 2]:
            STEPS.setdefault(c, set()).add(other)
            STEPS.setdefault(other, set()).add(c)


class GuessCost:
    """log10 of the guesses needed for a value: its cheapest segmentation into words, dates, repeats, walks and single characters.

    Every span costs what an attacker who knows its kind would try. The dynamic programme runs over end positions; spans of a
    kind are found by a scan, so a value of n characters takes n times the longest span.
    """

    def __init__(self, words: tuple[str, ...] = tuple(COMMON)):
        self.ranks = {w: i + 1 for i, w in enumerate(dict.fromkeys(words))}
        self.longest = max(map(len, self.ranks), default=0)

    def spans(self, value: str) -> Iterator[tuple[int, int, float]]:
        low = value.lower()
        plain = low.translate(LEET)
        n = len(value)
        for i in range(n):
            for j in range(i + 3, min(n, i + self.longest) + 1):
                rank = self.ranks.get(low[i:j]) or self.ranks.get(plain[i:j])
                if rank:
                    changed = (value[i:j] != low[i:j]) + (low[i:j] not in self.ranks)
                    yield i, j, math.log10(rank) + 0.6 * changed
            for date in (DATES.match(value, i),):
                if date:
                    yield i, date.end(), math.log10(120 * (1 if date.end() - i == 4 else 365))
        for unit in (1, 2, 3, 4):
            i = 0
            while i + 2 * unit <= n:
                j = i
                while j + unit < n and value[j] == value[j + unit]:
                    j += 1
                if j - i >= max(unit, 2):
                    end = j + unit
                    yield i, end, unit * brute(value[i : i + unit]) + math.log10((end - i) / unit)
                i = max(j, i) + 1
        for near in (lambda a, b: b in STEPS.get(a, ()), lambda a, b: any(a + b in s or b + a in s for s in SEQUENCES)):
            i = 0
            while i < n - 1:
                j = i
                while j + 1 < n and near(low[j], low[j + 1]):
                    j += 1
                if j - i >= 2:
                    turns = sum(low[k - 1] != low[k + 1] for k in range(i + 1, j))
                    for end in range(i + 3, j + 2):
                        yield i, end, math.log10(47) + 0.3 * min(turns, end - i - 2)
                i = max(j, i + 1)

    def table(self, value: str, single: float) -> tuple[list[float], list[tuple[int, int, float]]]:
        """Least cost of every beginning, and the spans."""
        best = [0.0] * (len(value) + 1)
        ends: dict[int, list[tuple[int, float]]] = {}
        spans = list(self.spans(value))
        for i, j, cost in spans:
            ends.setdefault(j, []).append((i, cost))
        for j in range(1, len(best)):
            best[j] = min([best[j - 1] + single, *(best[i] + cost for i, cost in ends.get(j, ()))])
        return best, spans

    def __call__(self, value: str, enough: float = math.inf) -> float:
        """The cost, or a lower bound of it that is `enough` or more: every segmentation of a long value crosses the middle of its
        head from one of the states that are open there."""
        single, head = brute(value), HEAD
        while enough < math.inf and head < len(value):
            best, spans = self.table(value[:head], single)
            middle = head // 2
            bound = min(best[max(middle - max(self.longest, 10), 0) : middle + 1] + [best[i] for i, j, _ in spans if i <= middle < j])
            if bound >= enough:
                return bound
            head *= 4
        return self.table(value, single)[0][-1]


def vocabulary_words(path: str) -> list[str]:
    """Whole words of a tokenizer file that marks word ends, in the file's own order, which is by frequency."""
    with open(path, encoding="utf-8") as f:
        entries = json.load(f)["model"]["vocab"]
    return [w[:-4] for w in sorted(entries, key=entries.get) if re.fullmatch("[a-z]{3,20}</w>", w)]


def ranked_words(docs: DataFrame, vocabulary: str | None = None, text_col: str = "text", most: int = RANKED_WORDS) -> tuple[str, ...]:
    """Words by rank: COMMON, then by turns those of the vocabulary file and the `most` that most documents use.

    All documents are counted, without their credential-context values, so that a copied password does not become a word. Words
    have 4 to 30 letters and stand in RANKED_DOCUMENTS documents or more; of these, all that are used as much as a least use, the
    smallest step of a sixteenth octave that leaves `most` or fewer. Only they reach the driver. Null texts have no words.
    """
    text = F.lower(F.col(text_col).cast("string"))
    plain = F.when(text.rlike("|".join(HINTS)), F.regexp_replace(text, F.lit("(?i)" + CONTEXT.pattern), F.lit(" "))).otherwise(text)
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(plain, F.lit(r"(?<!\p{L})\p{L}{4,30}(?!\p{L})"), F.lit(0)))).alias("word"))
    counts = stored(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= RANKED_DOCUMENTS), "ranked-words")
    step = F.floor(16 * F.log2("n")).cast("int")  # some hundred steps of use, however many documents there are
    sizes = {r.step: r.words for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()}
    lowest, taken = max(sizes, default=0) + 1, 0
    for at in sorted(sizes, reverse=True):
        taken += sizes[at]
        if taken > most:
            break
        lowest = at
    own = [r.word for r in sorted(counts.filter(step >= lowest).collect(), key=lambda r: (-r.n, r.word))]
    known = vocabulary_words(vocabulary) if vocabulary else []
    return tuple(dict.fromkeys([*COMMON, *(w for pair in zip_longest(known, own) for w in pair if w)]))


def brute(value: str) -> float:
    """log10 of the alphabet that a value draws on."""
    sizes = ((str.isdigit, 10), (str.islower, 26), (str.isupper, 26))
    size = sum(n for test, n in sizes if any(map(test, value)))
    return math.log10((size + 33 * any(not c.isalnum() for c in value)) or 26)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, leftmost and non-overlapping per kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def value_cost(value: str, least: float, cost: GuessCost) -> float:
    """An address without user and password costs what its dearest part behind the host does."""
    m = PLACE.match(value)
    return cost(value, least) if not m else max([cost(p, least) for p in re.split(r"[/?&=#]+", value[m.end() :]) if p], default=0.0)


def guess_spans(text: str, least: float, cost: GuessCost, seen: dict) -> list[tuple[int, int, int]]:
    """Credential-context values whose guess cost is `least` or more; the span is the value.

    A plain word behind "is" or "was" is read as prose and needs twice that cost.
    """
    low = text.lower()
    if not any(h in low for h in HINTS):
        return []
    out, at = [], 0
    while m := CONTEXT.search(text, at):
        value = m[2]
        needed = 2 * least if m[1] and PROSE.fullmatch(value) else least
        guesses = seen[value] if value in seen else value_cost(value, 2 * least, cost)
        if len(value) <= MEMO_CHARS:
            seen[value] = guesses
        if guesses >= needed:
            out.append((m.start(2), 3, m.end(2)))
        at = m.end() if guesses >= needed else m.start(2)  # a value that is none may hold the next context
    return out


def all_spans(text: str, least: float, cost, seen: dict) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    base = base_spans(text)
    starts, reach = [b[0] for b in base], [0, *accumulate((b[2] for b in base), max)]
    extra = [g for g in guess_spans(text, least, cost, seen) if reach[bisect_right(starts, g[0])] < g[2]]
    return base, sorted(base + extra)


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{i}:{j}" for i, k, j in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 9.0, words: tuple[str, ...] = tuple(COMMON)) -> DataFrame:
    """One row per document: counts per fixed kind, digest of the fixed spans, all spans.

    Fixed spans stay whatever their guess cost. `guess` spans are added for values in a credential context with a cost of
    10^`least` guesses or more (twice the exponent for a plain word behind "is" or "was"), unless a fixed span contains them; they may overlap. Positions are code points, ends are exclusive.
    `words` are ranked by use, see `ranked_words`. Null or empty text: zero counts, digest of the empty string, empty spans. Null ids and repeated rows are kept as they come.
    An empty table gives no rows. Columns other than the two named are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, seen = GuessCost(words), {}
        for batch in batches:
            rows = []
            for text in texts_of(batch.column(1)):
                base, spans = all_spans(text, least, cost, seen)
                trim(seen, MEMO_ENTRIES)
                kinds = [k for _, k, _ in spans]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), kinds.count(3), hashlib.sha256(told(base).encode()).hexdigest(), told(spans)))
            columns = list(zip(*rows)) if rows else [[]] * 6
            arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(c, pa.string()) for c in columns[4:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"])

    picked = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return picked.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for i, _, j in spans:
        if i >= at:
            out += [text[at:i], mark]
        at = max(at, j)
    return "".join([*out, text[at:]])


def redacted(text: Column, least: float = 9.0, words: tuple[str, ...] = tuple(COMMON), mark: str = "[secret]") -> Column:
    """The text with every span of `scan` replaced by `mark`; overlapping spans give one mark. Null stays null."""
    cost_words = tuple(words)

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo_of("secrets")
        cost, seen = GuessCost(cost_words), {}

        def one(text: str | None) -> str | None:
            trim(seen, MEMO_ENTRIES)
            return None if text is None else redact(text, all_spans(text, least, cost, seen)[1], mark)

        for series in batches:
            yield series.map(one)

    return clean(text)
