import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.llm import hard_negatives as HN

SCHEMA = "vec_id long, embedding array<float>, label int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows):
    """The contract, the plain way."""
    known = {}
    for i, x, label in rows:
        if i is None or x is None or label is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        x = [float(np.float32(v)) for v in x]
        if i not in known or (label, x) < known[i]:
            known[i] = (label, x)
    q = {i: (label, [math.floor(256 * v) for v in x]) for i, (label, x) in known.items()}
    out = []
    for a, (label, x) in q.items():
        if a % 50:
            continue
        score = {i: sum(p * r for p, r in zip(x, y)) for i, (_, y) in q.items() if i != a}  # noqa: B905
        best = lambda ids: sorted(ids, key=lambda i: (-score[i], i))  # noqa: E731, B023
        for p in best([i for i in score if q[i][0] == label])[:5]:
            fit = [i for i in score if q[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, k, i, score[p], score[i]) for k, i in enumerate(best(fit)[:3], 1)]
    return sorted(out)


def run(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in HN.hard_negatives(df).select(*COLUMNS).collect())


def cloud(n, dim, seed, spread=0.1, labels=4):
    r = random.Random(seed)
    centres = [[r.gauss(0, 0.3) for _ in range(dim)] for _ in range(labels)]
    which = [r.randrange(labels) for _ in range(n)]
    return [(i, [c + r.gauss(0, spread) for c in centres[k]], k) for i, k in enumerate(which)]


@pytest.mark.parametrize(("spread", "dim"), [(0.02, 8), (0.5, 3), (0.2, 64)])
def test_against_brute_force(spark, spread, dim):
    rows = cloud(500, dim, dim, spread)
    got = run(spark, rows)
    assert got == brute(rows) and got


def test_several_blocks_of_anchors_and_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(HN, "ANCHOR_BYTES", 700)
    rows = cloud(300, 5, 9) + [(i, [0.5, 0.25, 0.0, 0.1, -0.2], i % 2) for i in range(300, 700)]
    assert run(spark, rows, 5) == brute(rows)


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.8, 0.1], 2), (2, [0.7, 0.1], 2), (2, [0.7, 0.1], 2), (3, None, 1), (4, [1.0, 0.0], None), (5, [inf, 0.0], 1),
            (6, [nan, 1.0], 2), (8, [None, 1.0], 2), (None, [1.0, 0.0], 1), (9, [], 2), (10, [0.0, 0.0], 1), (11, [0.7], 3), (12, [0.6, 0.0, 5.0], 3),
            (50, [0.0, 0.0], 1), (100, [-1.0, 0.0], 1), (-50, [1.0, 1.0, 1.0], 3), (7, [0.95, 0.0], 0), (14, [0.5, 0.5], 9), (150, [3e38, -3e38], 5)]
    got = run(spark, rows[:-1])
    assert got == brute(rows[:-1]) and got
    assert run(spark, [(None, None, None)]) == run(spark, []) == []
    assert run(spark, rows)  # components beyond the integers' range saturate
    df = spark.createDataFrame(rows[:-1], SCHEMA)
    for name in ("vector", "norm", "angles", "score", "id", "rank", "anchor_id", "wanted"):
        df = df.withColumn(name, F.lit("x"))
    assert sorted(tuple(r) for r in HN.hard_negatives(df).select(*COLUMNS).collect()) == got


def test_bounds_hold_and_leave_rows_unscored():
    r = np.random.default_rng(3)
    centres = r.normal(0, 80, (6, 16))
    q = np.concatenate([np.floor(c + r.normal(0, 4, (200, 16))) for c in centres]).astype(np.int64)
    q[5] = 0
    directions = HN.directions_of([v.tobytes() for v in q])
    assert len(directions) == HN.REFERENCES
    norm, angle = HN._angles(q, directions)
    skipped = 0
    for k in range(0, len(q), 37):
        low, high = HN.bounds(norm[k], angle[k], norm, angle)
        exact = HN.scores(q, q[k])
        assert (exact == q @ q[k]).all() and (low <= exact).all() and (exact <= high).all()
        skipped += (high < 0.8 * norm[k] ** 2).sum()
    assert skipped > 0.3 * len(q) * len(range(0, len(q), 37))
