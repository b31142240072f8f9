import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from daysieve.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, shard int, score string, v int, rank double"


def plain(rows, anchor, k=5, m=3, low=50, high=95):
    """All pairs, in Python integers."""
    fine = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            fine[i] = min(fine.get(i, (v, str(label))), (v, str(label)))
    whole = {i: [math.floor(256 * x) if abs(x) < 1e300 else int(x) * 256 for x in v] for i, (v, _) in fine.items()}
    out = []
    for a in sorted(filter(anchor, fine)):
        score = {i: max(-hn.LONG, min(hn.LONG, sum(x * y for x, y in zip(whole[a], whole[i])))) for i in fine if i != a}
        first = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in first if fine[i][1] == fine[a][1]][:k]:
            inside = [i for i in first if fine[i][1] != fine[a][1] and low * score[p] <= 100 * score[i] <= high * score[p]]
            out += [(a, p, n + 1, i, score[p], score[i]) for n, i in enumerate(inside[:m])]
    return sorted(out)


def mined(spark, rows, every=5, **more):
    df = spark.createDataFrame([(*r, 1, "x", 2, 0.5) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in hn.mine(df, F.col("vec_id") % every == 0, **more).collect())


def odd_vectors(seed, n=150, dim=6):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0.3, 1) for _ in range(dim)], rng.randrange(4)) for i in range(n)]
    rows += [(n + i, list(rows[0][1]), i % 4) for i in range(40)]  # one common vector
    rows += [(n + 50 + i, [float(rng.randrange(3)) for _ in range(dim)], i % 3) for i in range(40)]  # ties
    rows += [rows[5], rows[10], (10, [9.0] * dim, 1), (10, [-9.0] * dim, 2)]  # rows and ids again
    rows += [(1000, None, 1), (1005, [1.0] * dim, None), (None, [1.0] * dim, 1), (1010, [1.0, None], 1), (1015, [float("nan")] * dim, 1), (1020, [float("inf")] * dim, 1)]
    rows += [(1025, [0.0] * dim, 1), (1030, [], 1), (1035, [1.0, 2.0], 2), (1040, [-0.001] * dim, 3), (1045, [1.0] * (dim + 3), 0)]
    return rows


@pytest.mark.parametrize("shard_rows, block", [(4096, 2048), (40, 7)])
def test_all_pairs_and_odd_rows(spark, monkeypatch, shard_rows, block):
    monkeypatch.setattr(hn, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(hn, "BLOCK_ANCHORS", block)
    rows = odd_vectors(seed=block)
    want = plain(rows, lambda i: i % 5 == 0)
    assert want and mined(spark, rows) == want
    assert mined(spark, rows, positives=2, negatives=7, low=0, high=100) == plain(rows, lambda i: i % 5 == 0, 2, 7, 0, 100)


def test_great_components_are_exact_or_held(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) * 10.0 ** rng.choice([0, 4, 8, 30, 307]) for _ in range(4)], i % 2) for i in range(60)]
    assert mined(spark, rows) == plain(rows, lambda i: i % 5 == 0)


def test_few_rows_and_none(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.75], 2)]) == [(0, 1, 1, 2, 65536, 49152)]
    assert mined(spark, [(1, [1.0], 1)]) == []  # no anchor


def test_reading_stops_before_the_end():
    """With few dimensions that matter, the lists are left early; ties at the threshold are read to their end."""
    rng = np.random.default_rng(1)
    x = hn.scaled(rng.normal(size=(4000, 3)))
    order = np.argsort(x, axis=0, kind="stable").T.astype(np.uint16)
    shard = hn.Shard(np.arange(4000), [str(i % 2) for i in range(4000)], x, order)
    a = hn.scaled(np.array([2.0, 0.01, -0.01]))
    seen = []
    read = shard.read
    shard.read = lambda *args: seen.append(read(*args)) or seen[-1]
    ids, scores = shard.positives(0, "0", a, 5)
    whole = (x @ a).astype(int)
    fit = [i for i in range(2, 4000, 2)]
    assert ids.tolist() == sorted(fit, key=lambda i: (-whole[i], i))[:5]
    assert seen[0][0].sum() < 2000
    same = hn.Shard(np.arange(100), ["0"] * 100, np.ones((100, 3)), np.argsort(np.ones((100, 3)), axis=0, kind="stable").T.astype(np.uint16))
    assert same.positives(99, "0", np.ones(3), 5)[0].tolist() == [0, 1, 2, 3, 4]


def test_window_bounds():
    for score in (*range(-30, 30), 12345):
        low, high = hn.window(score, 50, 95)
        assert [x for x in range(-50, 50) if 50 * score <= 100 * x <= 95 * score] == [x for x in range(-50, 50) if low <= x <= high]
