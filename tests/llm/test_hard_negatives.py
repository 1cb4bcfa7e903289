import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackuse.llm import hard_negatives
from trackuse.llm.hard_negatives import Residues, best_alike, mined

SCHEMA = "vec_id long, embedding array<float>, label int"


def clashing(df):
    return df.select("*", *[F.lit("own").alias(c) for c in "x class copy block rank score tops window is_anchor anchor_id".split()])


def brute_force(rows, nearest=5):
    """All scores one by one, in Python's whole numbers."""
    used = set()
    longest = max((len(v) for _, v, _ in rows if v), default=0)
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or not vector or len(vector) != longest:
            continue
        if any(c is None or not math.isfinite(c) for c in vector):
            continue
        x = tuple(math.floor(256 * Fraction(float(np.float32(c)))) for c in vector)
        used.add((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, x))
    out = []
    for a in used:
        if a[0] % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(a[2], r[2], strict=True)), *r) for r in used if r[0] != a[0])
        for pos in [r for r in scored if r[2] == a[1]][:nearest]:
            inside = [r for r in scored if r[2] != a[1] and 80 * -pos[0] <= 100 * -r[0] <= 100 * -pos[0]]
            out += [(a[0], pos[1], k, r[1], -pos[0], -r[0]) for k, r in enumerate(inside[:nearest], 1)]
    return sorted(out)


def made(rng, n, size, step=0.25, spread=1.0):
    """Rows whose entries lie on a coarse grid, so that many scores tie."""
    return [
        (i * 5, [rng.randrange(-3, 6) * step * spread for _ in range(size)], rng.randrange(4)) for i in range(n)
    ]


@pytest.mark.parametrize(("size", "spread"), [(3, 1.0), (70, 1.0), (8, 4096.0)])
def test_equal_to_brute_force(spark, size, spread, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAST_BLOCK", 40)  # several blocks
    rows = made(random.Random(size), 240, size, spread=spread)
    got = sorted(map(tuple, mined(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == brute_force(rows) and len(got) > 100


def test_odd_rows(spark):
    rng = random.Random(3)
    rows = made(rng, 120, 4)
    nan, inf = float("nan"), float("inf")
    rows += [(None, [1.0] * 4, 1), (1, None, 1), (2, [1.0, None, 1.0, 1.0], 1), (3, [nan] * 4, 1), (4, [inf] * 4, 1)]
    rows += [(6, [1.0] * 4, None), (8, [], 2), (9, [1.0] * 3, 2), (11, [3e38] * 4, 2)]
    rows += rows[:30] + [(500, [0.5, 0.5, 0.5, 0.25], 2), (7, [1.0] * 4, 9)]
    rows += [(700, [1.0, 0.0, 0.0, 0.0], 0), (700, [0.0, 1.0, 0.0, 0.0], 1)]
    usable = [r for r in rows if r[0] != 11]
    got = sorted(map(tuple, mined(clashing(spark.createDataFrame(rows, SCHEMA))).collect()))
    assert got == brute_force(usable) and got
    assert mined(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mined(spark.createDataFrame([(100, [1.0], 1), (200, [1.0], 2)], SCHEMA)).count() == 0


def test_residues_are_exact_for_large_numbers():
    rng = np.random.default_rng(4)
    for bits, size in ((7, 64), (20, 130), (29, 5)):
        a = rng.integers(-(1 << bits), 1 << bits, (30, size))
        b = rng.integers(-(1 << bits), 1 << bits, (40, size))
        a[0], b[0] = (1 << bits) - 1, -(1 << bits)
        residues = Residues(int(max((m.astype(object) ** 2).sum(axis=1).max() for m in (a, b))))
        got = residues.scores(residues.split(a), residues.split(b))
        assert (got == a.astype(object) @ b.T.astype(object)).all()


def test_ties_go_to_the_first_columns():
    scores = np.array([[5, 7, 5, 5, 7, 1], [2, 2, 2, 2, 2, 2]])
    i, j, s = best_alike(scores, np.array([[True] * 6, [False, True, True, True, True, False]]), 3)
    assert list(zip(i, j, s, strict=True)) == [(0, 1, 7), (0, 4, 7), (0, 0, 5), (1, 1, 2), (1, 2, 2), (1, 3, 2)]
