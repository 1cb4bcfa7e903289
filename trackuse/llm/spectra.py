"""Eigendecompositions that grow by one vector at a time.

A sum of outer products is held as eigenvalues and orthonormal eigenvectors. Adding
``rho v v'`` moves every eigenvalue to the root of a secular equation between it and
the next one; entries of ``v`` that vanish in the eigenbasis, and equal eigenvalues,
are deflated first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

EPS = np.finfo(np.float64).eps
STEPS = 60


def secular_roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + sum(weights / (poles - t))``, as the number of the nearest pole and the distance from it.

    ``poles`` rise strictly and ``weights`` are positive; root i lies between pole i and
    the next one, the last within the sum of weights behind the last pole. Each step
    solves for one pole on each side with the slopes of both sums kept, and halves the
    interval where that leaves it.
    """
    n = len(poles)
    ends = np.append(poles[1:], poles[-1] + weights.sum())
    gap = ends - poles
    middle = poles + gap / 2
    at_middle = 1 + (weights / (poles[None, :] - middle[:, None])).sum(axis=1)
    right = at_middle < 0  # the function rises: the root is in the right half
    right[-1] = False
    near = np.arange(n) + right
    offsets = poles[None, :] - poles[near][:, None]
    low = np.where(right, -gap / 2, 0.0)
    high = np.where(right, 0.0, np.where(np.arange(n) == n - 1, gap, gap / 2))
    t = (low + high) / 2
    left_side = np.tri(n, dtype=bool)
    own, after = np.arange(n), np.minimum(np.arange(n) + 1, n - 1)
    open_ = np.arange(n)
    for _ in range(STEPS):
        o, x = offsets[open_], t[open_]
        away = o - x[:, None]
        terms = weights / away
        slopes = terms / away
        is_left = left_side[open_]
        psi, dpsi = np.where(is_left, terms, 0).sum(axis=1), np.where(is_left, slopes, 0).sum(axis=1)
        phi, dphi = terms.sum(axis=1) - psi, slopes.sum(axis=1) - dpsi
        f = 1 + psi + phi
        low[open_] = np.where(f < 0, x, low[open_])
        high[open_] = np.where(f > 0, x, high[open_])
        row = np.arange(len(open_))
        last = open_ == n - 1
        a1 = away[row, own[open_]]
        a2 = np.where(last, gap[-1] - x, away[row, after[open_]])
        c = f - a1 * dpsi - a2 * dphi
        a = (a1 + a2) * f - a1 * a2 * (dpsi + dphi)
        b = a1 * a2 * f
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(all="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            new = x + step
        inside = np.isfinite(new) & (new > low[open_]) & (new < high[open_])
        new = np.where(inside, new, (low[open_] + high[open_]) / 2)
        with np.errstate(invalid="ignore"):
            done = (np.abs(f) <= 4 * EPS * (1 + np.abs(psi) + np.abs(phi))) | (np.abs(step) <= EPS * np.abs(x))
        t[open_] = np.where(done, x, new)
        open_ = open_[~done]
        if not len(open_):
            break
    # a distance of nothing would put the root on its pole
    tiny = EPS * EPS * np.maximum(gap, np.finfo(np.float64).tiny)
    return near, np.where(right, np.minimum(t, -tiny), np.maximum(t, tiny))


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, rho: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, rising, and eigenvectors of ``vectors diag(values) vectors' + rho v v'`` with ``rho >= 0``."""
    z = vectors.T @ v * np.sqrt(rho)
    size = z @ z
    if not size > 0:
        return values, vectors
    tolerance = 8 * EPS * max(float(np.abs(values).max()), size)
    # eigenvalues that are as good as equal: turn their eigenvectors so that one of them has all of z
    starts = np.flatnonzero(np.append(True, np.diff(values) > tolerance))
    stops = np.append(starts[1:], len(values))
    if len(starts) < len(values):
        vectors = vectors.copy()
        for a, b in zip(starts, stops, strict=True):
            if b - a > 1 and (length := np.linalg.norm(z[a:b])) > 0:
                mirror = z[a:b].copy()
                mirror[0] += np.copysign(length, mirror[0])
                mirror /= np.linalg.norm(mirror)
                vectors[:, a:b] -= 2 * np.outer(vectors[:, a:b] @ mirror, mirror)
                z[a] = -np.copysign(length, z[a])
                z[a + 1 : b] = 0
    moved = np.flatnonzero(np.abs(z) * np.sqrt(size) > tolerance)
    if not len(moved):
        return values, vectors
    poles, weights = values[moved], z[moved] ** 2
    near, t = secular_roots(poles, weights)
    roots = poles[near] + t
    # differences root - pole without cancellation, and the z for which these roots are exact
    away = poles[near][None, :] - poles[:, None] + t[None, :]
    k = len(moved)
    lower = np.tri(k, k, -1, dtype=bool)  # roots before the pole meet the pole of the same number
    partner = np.where(lower, np.arange(k)[None, :], np.minimum(np.arange(k) + 1, k - 1)[None, :])
    below = poles[partner] - poles[:, None]
    below[:, -1] = 1.0
    exact = np.sqrt(np.abs((away / np.where(below == 0, 1.0, below)).prod(axis=1)))
    q = np.copysign(exact, z[moved])[:, None] / -away
    q /= np.linalg.norm(q, axis=0)
    values, vectors = values.copy(), vectors.copy()
    values[moved] = roots
    vectors[:, moved] = vectors[:, moved] @ q
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Number and mean of some vectors, and the eigendecomposition of their centred scatter."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, size: int) -> Spectrum:
        return cls(0, np.zeros(size), np.zeros(size), np.eye(size))

    def add(self, x: np.ndarray) -> None:
        """One more vector: a rank-one update by its distance from the mean so far."""
        away = x - self.mean
        if self.n:
            self.values, self.vectors = rank_one(self.values, self.vectors, away, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + away / self.n

    def merge(self, other: Spectrum) -> None:
        """The vectors of ``other`` too: a rank-one update for each of its eigenvalues and one for the means."""
        if not other.n or not self.n:
            if other.n:
                self.n, self.mean, self.values, self.vectors = other.n, other.mean, other.values, other.vectors
            return
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, float(value))
        away = other.mean - self.mean
        n = self.n + other.n
        self.values, self.vectors = rank_one(self.values, self.vectors, away, self.n * other.n / n)
        self.n, self.mean = n, self.mean + away * (other.n / n)
