"""Token counts of whole texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.llm.common import by_bytes, memo_of, texts_of, trim, utf8_size

SPACE = "▁"  # the model's own sign for a space
SAFE = re.compile(f"(?<=[^ {SPACE}]) (?=[^ {SPACE}])")
BATCH_BYTES = 1 << 20
CUT_CHARS = 1 << 14  # pieces longer than this are cut further
PROBE = " ﬁ½  é\n \u3000x "  # a normaliser would change it
MEMO_ENTRIES = 400_000


def safe_pieces(text: str) -> list[str]:
    """Cuts a text at single spaces between two other characters.

    The model puts its space sign before the first character of a text, and no entry of its vocabulary holds that sign behind
    another character, so counting the pieces apart gives the count of the whole.
    """
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " " or SPACE in text:
        return SAFE.split(text)
    return text.split(" ")


class Counter:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        vocabulary = [self.model.id_to_piece(i) for i in range(size)]
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in vocabulary)
        self.seen: dict[str, int] = {}
        # Characters that stand behind no other one in any entry. Without a normaliser, and with single bytes for what the
        # vocabulary lacks, no token reaches over the place before such a character.
        exact = self.model.normalize(PROBE) == SPACE + PROBE.replace(" ", SPACE)
        behind = {" ", SPACE} | {c for i, p in enumerate(vocabulary) if not self.model.is_byte(i) for c in p[1:]}
        self.head = re.compile(f"[^{re.escape(''.join(sorted(behind)))}]") if exact and any(map(self.model.is_byte, range(size))) else None

    def cuts(self, piece: str) -> list[str]:
        """A piece without usable spaces, cut before head characters about every CUT_CHARS."""
        out, at = [], 0
        while self.head and len(piece) - at > CUT_CHARS and (m := self.head.search(piece, at + CUT_CHARS)):
            out.append(piece[at : m.start()])
            at = m.start()
        return [*out, piece[at:]]

    def long_length(self, piece: str) -> int:
        """Every further cut starts with the model's space sign, alone in a token because a head never stands behind it."""
        cuts = self.cuts(piece)
        return sum(len(ids) for run in by_bytes(cuts, BATCH_BYTES) for ids in self.model.encode(run, num_threads=1)) - len(cuts) + 1

    def lengths(self, texts: list[str]) -> list[int]:
        if not self.splits:
            return [len(x) for run in by_bytes(texts, BATCH_BYTES) for x in self.model.encode(run, num_threads=1)]
        pieces = [safe_pieces(t) for t in texts]
        trim(self.seen, MEMO_ENTRIES)
        seen, fresh = self.seen, set(chain.from_iterable(pieces)).difference(self.seen)
        long = {p: self.long_length(p) for p in fresh if len(p) > CUT_CHARS}
        for run in by_bytes(fresh.difference(long), BATCH_BYTES):
            for p, ids in zip(run, self.model.encode(run, num_threads=1)):
                (seen if len(p) <= 64 else long)[p] = len(ids)
        if long:
            return [sum(seen[p] if p in seen else long[p] for p in ps) for ps in pieces]
        return [sum(map(seen.__getitem__, ps)) for ps in pieces]


def counter(path: str) -> Counter:
    own = memo_of("tokens")
    if path not in own:
        own[path] = Counter(path)
    return own[path]


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) of every row.

    Texts reach the workers in Arrow batches, are grouped by size into runs of about BATCH_BYTES bytes, cut at safe
    boundaries (single spaces; in long pieces without them, characters that no vocabulary entry holds behind another, such as line
    ends and ideographs), and only lengths come back. Null text counts as empty: 0 bytes, 0 tokens. Null ids and repeated rows are kept as
    they are. An empty table gives no rows. Columns other than the two named are ignored. `model` is the path of a sentencepiece
    file on the workers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model)
        for batch in batches:
            texts = texts_of(batch.column(1))
            tokens = [n for part in by_bytes(texts, 4 * BATCH_BYTES) for n in c.lengths(part)]
            sizes = [utf8_size(t) for t in texts]
            over = [n > limit for n in tokens]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(over, pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    picked = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return picked.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
