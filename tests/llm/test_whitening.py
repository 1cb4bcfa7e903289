import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackuse.llm import whitening
from trackuse.llm.spectra import Spectrum, rank_one, secular_roots
from trackuse.llm.whitening import whitened

SCHEMA = "vec_id long, embedding array<float>, label int"


def clashing(df):
    return df.select("*", *[F.lit("own").alias(c) for c in "x part n mean component whitened i total".split()])


def made(n, size, seed=0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, size)) * np.linspace(0.1, 0.4, size)).astype(np.float32)


def plain(vectors, k=16):
    """Whole covariance matrix of the distinct vectors, its eigenvectors, and exact deviations."""
    x = np.floor(64 * vectors.astype(np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums) / n
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    trace = (centred**2).sum() / n
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    return n, deviation, ((n * x - sums) / n) @ turn / np.sqrt(values), values / trace


@pytest.mark.parametrize(("n", "size"), [(400, 24), (30, 3), (2, 5), (9, 1)])
def test_equal_to_a_dense_decomposition(spark, n, size, monkeypatch):
    monkeypatch.setattr(whitening, "PART_ROWS", 40)  # several parts and two levels of merging
    monkeypatch.setattr(whitening, "FAN_IN", 3)
    vectors = made(n, size)
    vectors = np.concatenate([vectors, vectors[: n // 2]])  # repeated vectors count once in the fit
    found = whitened(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], SCHEMA)).collect()
    count, deviation, white, explained = plain(vectors)
    k = min(16, size, count - 1)
    assert len(found) == len(vectors) * k
    signs = {}
    for r in sorted(found):
        c = r.component - 1
        own = white[r.vec_id, c]
        sign = signs.setdefault(c, np.sign(own * r.whitened) or 1)
        assert r.n == count and r.deviation == deviation[r.vec_id]
        assert math.isclose(r.whitened, sign * own, abs_tol=1e-8)
        assert math.isclose(r.explained, explained[c], rel_tol=1e-9)
        assert r.identity_error < 1e-9


def test_merged_spectra_alone_are_exact(spark, monkeypatch):
    monkeypatch.setattr(whitening, "PART_ROWS", 64)
    x = np.floor(64 * made(500, 20).astype(float)).astype(np.int64) + 1_000_000
    fit = spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>")
    centre = whitening._centre(fit, 20)
    assert centre.n == 500 and centre.sums == x.sum(axis=0).tolist()
    found = whitening.merged_spectrum(fit, centre, 20)
    away = x - x.mean(axis=0)
    expected = np.linalg.eigvalsh(away.T @ away)
    assert found.n == 500 and np.allclose(found.values, expected, rtol=1e-10)
    assert np.abs(found.vectors.T @ found.vectors - np.eye(20)).max() < 1e-12


def test_odd_rows(spark):
    vectors = made(60, 6, seed=2)
    nan, inf = float("nan"), float("inf")
    rows = [(i if i else None, v.tolist(), None) for i, v in enumerate(vectors)]
    bad = [(91, None, 1), (92, [], 1), (93, [nan] * 6, 1), (94, [0.1, None, 0.0, 0.0, 0.0, 0.0], 1), (95, [inf] * 6, 1), (96, [0.5] * 5, 1)]
    found = whitened(clashing(spark.createDataFrame(rows + bad + rows[:3], SCHEMA)))
    got = found.collect()
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(got) == 63 * 6 and {r.vec_id for r in got} == {None, *range(1, 60)} and {r.n for r in got} == {60}
    assert len({(r.component, r.whitened) for r in got if r.vec_id == 1}) == 6
    assert whitened(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitened(spark.createDataFrame([(1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0)], SCHEMA)).count() == 0


def test_large_entries_keep_exact_deviations(spark):
    rows = [(i, [float(2**k) * s for k in (3, 20)], 0) for i, s in enumerate((1, -1, 3))] + [(9, [2.0**45, 1.0], 0)]
    found = {r.vec_id: r for r in whitened(spark.createDataFrame(rows, SCHEMA)).collect()}
    x = {i: [int(64 * c) + 1_000_000 for c in v] for i, v, _ in rows}
    sums = [sum(c) for c in zip(*x.values(), strict=True)]
    for i, v in x.items():
        deviation = sum((4 * a - b) ** 2 for a, b in zip(v, sums, strict=True))
        assert found[i].deviation == (deviation if deviation < 1 << 63 else None)


def test_no_component_without_variance(spark):
    vectors = made(40, 5, seed=3)
    vectors[:, 2] = vectors[:, 1]
    vectors[:, 4] = 0.25
    found = whitened(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], SCHEMA)).collect()
    assert {r.component for r in found} == {1, 2, 3} and max(r.identity_error for r in found) < 1e-9


def test_secular_roots_and_deflation():
    rng = np.random.default_rng(5)
    for trial in range(60):
        size = int(rng.integers(1, 12))
        base = rng.normal(size=(size, size)) * 10.0 ** rng.integers(-3, 4)
        matrix = base @ base.T if trial % 3 else np.diag(rng.integers(0, 3, size).astype(float))
        values, vectors = np.linalg.eigh(matrix)
        v = rng.normal(size=size) * (rng.random(size) < 0.7)
        got, turned = rank_one(values, vectors, v, 0.5)
        whole = matrix + 0.5 * np.outer(v, v)
        scale = max(np.abs(whole).max(), 1e-300)
        assert np.abs(got - np.linalg.eigvalsh(whole)).max() <= 1e-12 * scale
        assert np.abs(turned @ np.diag(got) @ turned.T - whole).max() <= 1e-12 * scale
        assert np.abs(turned.T @ turned - np.eye(size)).max() < 1e-12
    near, t = secular_roots(np.array([0.0, 1.0, 1.0 + 1e-9]), np.array([1.0, 1e-12, 1.0]))
    assert near[0] in (0, 1) and (t != 0).all()


def test_updates_one_by_one_equal_the_scatter():
    x = made(200, 12, seed=6).astype(float)
    x = np.concatenate([x, np.repeat(x[:3], 20, axis=0)])
    found = Spectrum.empty(12)
    for v in x:
        found.add(v)
    away = x - x.mean(axis=0)
    assert np.allclose(found.values, np.linalg.eigvalsh(away.T @ away), rtol=1e-11)
    assert np.allclose(found.mean, x.mean(axis=0))
