"""Hard negatives against a nested loop in plain Python integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dqspark.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, score long, cell int, place string"


def brute(rows):
    rows = [(i, [math.floor(256 * x) for x in v], lab, n) for n, (i, v, lab) in enumerate(rows)
            if i is not None and v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, lab, n in rows:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m, other == lab) for j, w, other, m in rows if m != n)
        for p in [s for s in scored if s[3]][:5]:
            good = [s for s in scored if not s[3] and 30 * -p[0] <= 100 * -s[0] <= 90 * -p[0]][:10]
            out += [(i, p[1], k, s[1], -p[0], -s[0]) for k, s in enumerate(good, 1)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(i, v, lab, 1, 2, "x") for i, v, lab in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in H.hard_negatives(df, F.col("vec_id") % 100 == 0).collect())


@pytest.mark.parametrize("spread", [9, 300, 1 << 20, 1 << 40])
def test_packed_scores_are_exact(spread):
    rng = np.random.default_rng(spread)
    for dim, n, m in ((1, 1, 1), (7, 5, 131), (64, 9, 70)):
        a, b = rng.integers(-spread, spread, (n, dim)), rng.integers(-spread, spread // 2, (m, dim))
        want = [[max(-H.LARGEST, min(H.LARGEST, sum(int(x) * int(y) for x, y in zip(u, v)))) for v in b] for u in a]
        assert H.packed_scores(a, b).tolist() == want
    assert H.packed_scores(np.zeros((2, 0), np.int64), np.zeros((3, 0), np.int64)).tolist() == [[0] * 3] * 2


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(H, "ANCHORS", 4)
    monkeypatch.setattr(H, "SLABS", 3)
    rng = random.Random(7)
    def vector(n=6):
        return [rng.gauss(0.2, 0.4) for _ in range(n)]
    hot = [0.5] * 6
    rows = [(i * 10, vector(), rng.randrange(3)) for i in range(150)]
    rows += [(i * 10 + 1, hot, 1) for i in range(80)]       # one vector for a third of the rows
    rows += [(i * 100, hot, 2) for i in range(30, 36)]
    rows += [(100, None, 1), (200, vector(), None), (None, vector(), 1), (300, [math.nan] * 6, 1), (400, [math.inf] + [0.0] * 5, 1),
             (500, [None] * 6, 0), (600, vector(3), 1), (700, [], 2), (800, [1e6] * 6, 0), (901, [1e6, -1e6, 0.0, 0.0, 0.0, 1e5], 1)]
    rows += [(2001, hot, 1), (2001, hot, 1), (2003, vector(), 0)]
    rows += [rows[0], rows[10]]                             # repeated anchors
    got, want = mined(spark, rows), brute(rows)
    assert len(want) > 500 and got == want


def test_nothing_to_find(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []          # no anchor
    assert mined(spark, [(100, [1.0], 1), (2, [0.5], 2)]) == []        # no positive
    assert mined(spark, [(100, [1.0], 1), (3, [-1.0], 1), (2, [0.5], 2)]) == []  # negative score: empty range
