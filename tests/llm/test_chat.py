"""Viterbi against all state sequences, held-out role accuracy, and odd transcripts."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from clausemill.llm import chat

SF = "/root/testdata/sf0.001"


def model_of(spark, sf=SF):
    return chat.learn(chat.as_transcript(spark.read.parquet(f"{sf}/conversations.parquet")).withColumnRenamed("part", "turn"))


def test_viterbi(spark):
    m = model_of(spark)
    rng = np.random.default_rng(0)
    for _ in range(10):
        rows = [tuple(int(rng.integers(0, n)) for n in chat.FEATURES) for _ in range(int(rng.integers(1, 5)))]

        def weight(path, rows=rows):
            total = m.first[path[0]] + sum(m.moves[a, b] for a, b in zip(path, path[1:]))
            return total + sum(m.emit[f][s, r[f]] for s, r in zip(path, rows) for f in range(len(chat.FEATURES)))

        best = max(weight(p) for p in itertools.product(range(chat.STATES), repeat=len(rows)))
        assert abs(weight(m.viterbi(rows)) - best) < 1e-9


def test_markers():
    first = lambda s: chat.features(s, None, False)[0]
    assert [first(s) for s in ("User: hi", "### Assistant: x", "[Q] why", "<system>: be kind", "**Human:** a", "plain", "users: x", "A tale")] == [2, 3, 2, 1, 2, 0, 0, 0]


def test_roles_held_out(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    raw = chat.as_transcript(turns)
    m = chat.learn(raw.withColumnRenamed("part", "turn"))
    got = chat.recover(raw, m).filter("turn = 0").select("conv_id", "part", F.col("role").alias("found"), F.col("text").alias("body"))
    held = turns.filter("crc32(cast(conv_id as string)) % 5 = 0").select("conv_id", F.col("turn").alias("part"), "role", "text")
    rows = held.join(got, ["conv_id", "part"], "left").collect()
    assert len(rows) > 50
    assert np.mean([r.role == r.found for r in rows]) > 0.9
    assert np.mean([r.body == r.text.strip() for r in rows if r.role == r.found]) > 0.9


def test_odd(spark):
    m = model_of(spark)
    rows = [(1, 0, "User: hello\nAssistant: hi\nmore of it\n\nand more\nUser: bye"), (1, 1, None), (1, 2, ""), (None, 0, "Human: a"), (1, None, "x"),
            (2, 0, "User: " + "word " * 50_000), (3, 0, "User: same"), (3, 0, "User: same")]
    df = spark.createDataFrame(rows, "conv_id long, part long, text string").withColumn("role", F.lit("clash"))
    got = chat.recover(df, m).collect()
    own = [(r.turn, r.role, r.text) for r in got if r.conv_id == 1]
    assert own[0] == (0, "user", "hello") and own[1] == (1, "assistant", "hi\nmore of it\n\nand more") and own[-1][2] == "bye"
    assert [r.text for r in got if r.conv_id is None] == ["a"] and [r.text for r in got if r.conv_id == 3] == ["same", "same"]
    assert got[0].rendered.startswith("<|im_start|>") and chat.recover(df.limit(0), m).count() == 0
    assert len(chat.learn(df.limit(0).selectExpr("conv_id", "part as turn", "role", "text")).emit) == len(chat.FEATURES)


def test_blocks(spark):
    """A conversation over many blocks gives the turns of one run over all its parts."""
    m = model_of(spark)
    rows = [(1, i, ("User: question?" if i % 2 == 0 else "Assistant: answer.") + f" {i}") for i in range(3 * chat.BLOCK)]
    got = chat.recover(spark.createDataFrame(rows, "conv_id long, part long, text string"), m).orderBy("part").collect()
    whole = chat.parse([t for _, _, t in rows], m)
    assert [(r.part, r.role, r.text) for r in got] == [(i, chat.ROLES[role], text) for i, role, text in whole]


def test_turns_across_blocks(spark):
    """Turns over several blocks keep all their parts, as in one run over the whole conversation."""
    m = model_of(spark)
    rng = np.random.default_rng(4)
    lines = ["User: please read this"] + [f"line {i} of the long paste, which" for i in range(1000)] + ["Assistant: done."]
    long = [(1, i, t) for i, t in enumerate(lines)]
    pool = ["User: why?", "Assistant: because.", "\n", "", "and so on, then", "plain closed line.", "\n\nWhat else is there?", "more of it\n\nUser: and now?"]
    mixed = [(c, i, str(t)) for c in (2, 3) for i, t in enumerate(rng.choice(pool, 900))] + [(4, i, "") for i in range(400)] + [(4, 400, "User: late"), (4, 1500, "x")]
    rows = long + mixed
    got = chat.recover(spark.createDataFrame(rows, "conv_id long, part long, text string"), m).collect()
    for c in (1, 2, 3, 4):
        texts, owner = [], []
        for _, i, t in [r for r in rows if r[0] == c]:
            texts += t.split("\n")
            owner += [i] * len(t.split("\n"))
        want, number = [], {}
        for i, role, text in chat.parse(texts, m):
            number[owner[i]] = n = number.get(owner[i], -1) + 1
            want.append((owner[i], n, chat.ROLES[role], text.strip()))
        assert sorted((r.part, r.turn, r.role, r.text) for r in got if r.conv_id == c) == sorted(want)
