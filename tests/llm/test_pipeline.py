"""The pipeline against a plain restatement of every stage, run in memory."""

import re
import sys
import zlib
from collections import Counter
from itertools import zip_longest
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline  # noqa: E402
from test_near_dups import brute  # noqa: E402

from clausemill.llm import decontamination as dc  # noqa: E402
from clausemill.llm import common, secrets, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"


def ranked(rows):
    """The ranked words, counted in memory."""
    counts = Counter(w for r in rows for w in set(re.findall(r"[^\W\d_]+", secrets.CONTEXT.sub(" ", (r.text or "").lower()))) if 4 <= len(w) <= 30)
    own = sorted((w for w, n in counts.items() if n >= 5), key=lambda w: (-counts[w], w))[:30_000]
    known = secrets.vocabulary_words(public_tokenizers.path("word_bpe_49k.json"))
    return tuple(dict.fromkeys([*secrets.COMMON, *(w for pair in zip_longest(known, own) for w in pair if w)]))


def plain(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scorer = toxicity.Scorer(model.weights)
    rows = [r for r in docs.collect() if model.probability(np.array([scorer.weight(r.text or "")]))[0] < 0.7]
    firsts = {c for _, c, _ in brute(rows)}
    rows = [r for r in rows if r.doc_id in firsts]
    items = [dc.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    tests = [(x, dc.Pattern(x)) for x in items if x]
    clean = []
    for r in rows:
        t = dc.normal(r.text or "")
        if not any(x in t or (len(t) < 2500 and p.best(t)[0] <= int(0.05 * len(x))) for x, p in tests):
            clean.append(r)
    words = ranked(clean)
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for r in clean:
        text = secrets.redact(r.text or "", secrets.all_spans(r.text or "", 9.0, secrets.GuessCost(words), {})[1], "[secret]")
        ids = [*tk.encode(text, add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            cut = ids[at : at + 2048]
            out.append((r.doc_id, n, at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
    return sorted(out)


def test_run(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == plain(spark)
    ends = {}
    for r in got:
        ends[r.sequence_id] = max(ends.get(r.sequence_id, 0), r.offset + r.length)
    assert max(ends.values()) <= 2048


def test_ranked_words(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = public_tokenizers.path("word_bpe_49k.json")
    assert secrets.ranked_words(docs, path) == ranked(docs.collect())
    few = secrets.ranked_words(docs, most=100)[len(dict.fromkeys(secrets.COMMON)):]
    every = [w for w in secrets.ranked_words(docs) if w not in secrets.COMMON]
    assert 0 < len(few) <= 100 and list(few) == every[: len(few)]
    copies = spark.createDataFrame([(i, "The password is Zkuqvanelo now", "s") for i in range(50)], odd.schema)
    assert "zkuqvanelo" not in secrets.ranked_words(copies) and "now" not in secrets.ranked_words(copies)
    assert secrets.ranked_words(none) == secrets.ranked_words(odd) == tuple(dict.fromkeys(secrets.COMMON))


def test_stages(spark, odd):
    docs = odd.selectExpr("doc_id", "text", "'en' AS lang", "score AS source", "length(text) AS n_chars", "1 AS bands", "'x' AS key")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
        docs = after
    assert {r.doc_id for r in docs.collect()} >= {1, 4, 5, 6}


def test_stages_hand_small_batches_to_workers(spark):
    """Whole texts go to a worker in batches of at most BATCH_ROWS; a smaller number set by the user stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    docs = spark.createDataFrame([(i, f"text {i}", "en", "web", 6) for i in range(3)], "doc_id long, text string, lang string, source string, n_chars long")
    try:
        for own, want in (("10000", common.BATCH_ROWS), ("0", common.BATCH_ROWS), ("7", 7)):
            for _, stage in corpus_pipeline.STAGES[1:2] + corpus_pipeline.STAGES[3:]:
                spark.conf.set(key, own)
                stage(spark, docs, SF)
                assert int(spark.conf.get(key)) == want
    finally:
        spark.conf.set(key, before)


def test_a_step_drops_what_others_left_in_its_worker():
    common.memo_of("one")["big"] = 1
    assert common.memo_of("one") == {"big": 1}
    assert common.memo_of("two") == {}
    assert common.memo_of("one") == {}


def test_words_are_ranked_once_a_task(spark, monkeypatch):
    """Masking builds its cost table once, not again for every batch of a task."""
    made = []
    monkeypatch.setattr(secrets, "GuessCost", lambda words, kind=secrets.GuessCost: made.append(1) or kind(words))
    clean = {}
    monkeypatch.setattr(secrets.F, "pandas_udf", lambda kind: lambda f: clean.setdefault("f", f) and (lambda text: text))
    secrets.redacted(secrets.F.lit("x"))
    parts = [pd.Series(["plain", None]), pd.Series(["password = Tr0ub4dor9xkQ7zW!"])]
    out = [x for s in clean["f"](iter(parts)) for x in s]
    assert out[:2] == ["plain", None] and "Tr0ub4dor9xkQ7zW" not in out[2]
    assert len(made) == 1
