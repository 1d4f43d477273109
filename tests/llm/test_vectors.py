"""Hard negatives and centroid clustering against brute force, with odd rows, ties and repeated rows."""

import math
from hashlib import sha256

import numpy as np
import pytest

from clausemill.llm import centroids, hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, score double"


def whole(v):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [max(-(1 << 26), min(1 << 26, math.floor(256 * x))) for x in v]


def plain_mine(rows, every=100, share=80):
    best = {}
    for i, v, label in rows:
        if i is None or label is None or whole(v) is None:
            continue
        key = (str(label), whole(v))
        best[i] = min(best.get(i, key), key)
    out = []
    for a, (label, x) in best.items():
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, other) for i, (other, y) in best.items() if i != a)
        for s, p, other in [r for r in scored if r[2] == label][:5]:
            fits = [r for r in scored if r[2] != label and share * -s <= 100 * -r[0] <= 100 * -s][:5]
            out += [(a, p, n, i, -s, -t) for n, (t, i, _) in enumerate(fits, 1)]
    return sorted(out)


def mined(df, **options):
    return sorted(tuple(r) for r in hn.mine(df, **options).collect())


def clustered(n, width, seed, groups=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width))
    return [(i, (centres[i % groups] + 0.2 * rng.normal(size=width)).tolist(), int(rng.integers(0, 4)), 1.0) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("tree_rows", [16, 4096])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, tree_rows):
    monkeypatch.setattr(hn, "TREE_ROWS", tree_rows)  # many regions and slices, or one
    rows = clustered(700, 8, 3)
    rows += [(1000 + i, rows[5][1], i % 3, 1.0) for i in range(150)]  # a hot vector with three labels
    assert mined(frame(spark, rows), every=20) == plain_mine([r[:3] for r in rows], every=20)


def test_hard_negatives_odd_rows(spark):
    rows = clustered(60, 4, 1)
    rows += [(0, rows[3][1], 2, 0.0), (0, rows[3][1], 2, 0.0), (None, [1.0, 1.0], 1, 0.0), (201, None, 1, 0.0), (202, [1.0, None], 1, 0.0), (203, [], 0, 0.0),
             (204, [math.nan], 1, 0.0), (205, [math.inf, 1.0], 1, 0.0), (206, [1.0, 0.5], None, 0.0), (300, [2.0], 1, 0.0), (301, [1e300, -1e300, 0.0, 0.0, 1.0], 3, 0.0)]
    df = frame(spark, rows)
    assert mined(df, every=10) == plain_mine([r[:3] for r in rows], every=10)
    assert mined(df.limit(0)) == [] and hn.mine(df.limit(0)).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    one = [(100, [1.0, 2.0], 1, 0.0)]
    assert mined(frame(spark, one)) == []


def test_tree_skips_and_is_exact():
    rng = np.random.default_rng(7)
    centres = rng.integers(-200, 200, size=(30, 16))
    x = (centres[rng.integers(0, 30, 3000)] + rng.integers(-6, 7, size=(3000, 16))).astype(np.int64)
    top = float((x.astype(float) ** 2).sum(axis=1).max())
    tree = hn.unpacked(hn.packed(hn.Tree(np.arange(3000), np.zeros(3000, np.int64), x, top)))
    leaves = [n for n in range(len(tree.spans)) if tree.children[n][0] == tree.children[n][1]]
    assert sorted(i for n in leaves for i in tree.ids[tree.spans[n][0] : tree.spans[n][1]]) == list(range(3000))
    for n in range(1, len(tree.spans)):
        a, b = tree.spans[n]
        d = np.sqrt(((hn.augmented(tree.x[a:b], top) - tree.centres[n]) ** 2).sum(axis=1))
        assert d.max() <= tree.radii[n] + 1e-6

    class Counting(np.ndarray):
        seen = 0

        def __getitem__(self, key):
            got = super().__getitem__(key)
            if isinstance(key, slice):
                Counting.seen += len(got)
            return got

    tree.ids = tree.ids.view(Counting)
    for q in x[:20]:
        scores = sorted(((-int(s), i) for i, s in enumerate(x @ q)))[:5]
        best = hn.Best(5, hn.NONE, math.inf)
        tree.descend(q, 0, True, [best])
        assert best.rows == scores
    assert Counting.seen < 20 * 3000 / 4  # most leaves are never computed


def plain_cluster(rows, count=40, rounds=5):
    kept = [(i, whole(v)) for i, v in rows if v is not None and len(v) == 64 and whole(v) is not None]
    seeds = sorted((sha256(f"2:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:count]
    c = [list(x) for _, x in seeds]

    def near(x):
        return min((sum((p - q) ** 2 for p, q in zip(x, y)), n) for n, y in enumerate(c))

    for _ in range(rounds):
        at = [near(x)[1] for _, x in kept]
        for n in range(len(c)):
            own = [x for (_, x), m in zip(kept, at) if m == n]
            if own:
                c[n] = [sum(d) // len(own) for d in zip(*own)]
    last = [near(x) for _, x in kept]
    out = []
    for (i, _), (d, n) in zip(kept, last):
        text = ",".join(map(str, c[n]))
        out.append((i, n, d, sum(e for e, m in last if m == n), sum(e for e, _ in last), sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_clusters_equal_brute_force_with_odd_rows(spark):
    rows = clustered(150, 64, 5, 6)
    hot = [round(v, 1) for v in rows[0][1]]
    rows += [(500 + i, hot, 0, 0.0) for i in range(80)] + [(600, hot, 0, 0.0)] * 3  # ties between centroids and repeated rows
    rows += [(None, rows[7][1], 1, 0.0), (700, None, 1, 0.0), (701, [1.0] * 63, 1, 0.0), (702, [None] + [1.0] * 63, 1, 0.0), (703, [math.nan] * 64, 1, 0.0),
             (704, [math.inf] * 64, 1, 0.0), (705, [1e300] * 64, None, 0.0), (706, [-0.001] * 64, None, 0.0)]
    df = frame(spark, rows)
    got = sorted((tuple(r) for r in centroids.cluster(df).collect()), key=str)
    assert got == plain_cluster([r[:2] for r in rows])
    assert centroids.cluster(df.limit(0)).collect() == []
    few = rows[:3]
    assert sorted((tuple(r) for r in centroids.cluster(frame(spark, few)).collect()), key=str) == plain_cluster([r[:2] for r in few])


def test_walk_equals_all_distances_and_stops_early():
    rng = np.random.default_rng(2)
    c = rng.integers(-300, 300, size=(40, 64))
    x = np.vstack([c[rng.integers(0, 40, 500)] + rng.integers(-3, 4, size=(500, 64)), rng.integers(-300, 300, size=(500, 64)), (c[:1] + c[1:2]) // 2, c])
    d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    near, far = centroids.Lists(c.tolist()).nearest(x)
    assert (near == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()
    twice = centroids.Lists([c[3].tolist(), c[3].tolist(), c[4].tolist()])
    assert twice.nearest(c[3:5])[0].tolist() == [0, 2]
    for width in (1, 2):
        small = rng.integers(-5, 6, size=(7, width))
        many = rng.integers(-8, 9, size=(400, width))
        d = ((many[:, None] - small[None]) ** 2).sum(axis=2)
        assert (centroids.Lists(small.tolist()).nearest(many)[0] == d.argmin(axis=1)).all()
