"""Whitening of embeddings by an incremental eigendecomposition.

Each task adds its vectors one by one to the spectrum of its part (``spectra``); spectra
are merged by further rank-one updates in a tree of small groups. The merged
eigenvectors are the basis of a Rayleigh-Ritz step: the covariance in that basis is
summed over all vectors on Spark, and its eigenvectors turn the basis into the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackuse.llm.spectra import EPS, Spectrum
from trackuse.llm.vectors import of_full_length, usable, whole_entries
from trackuse.sources.staging import discard, stage

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
PART_ROWS = 4_096  # rank-one updates in one task, up to MAX_PARTS tasks
MAX_PARTS = 100_000
FAN_IN = 8
SLICE = 1 << 20  # entries of a matrix that is worked on at once
LOW_BITS = 26

_SPECTRUM = "part long, n long, mean binary, eigenvalues binary, eigenvectors binary"
_RESULT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def _matrices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches, each with its vectors as the rows of a matrix."""
    step = max(1, SLICE // size)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


class Centre:
    """The exact mean of the fit list: ``n`` and the sums per dimension as whole numbers of any size."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.sums = n, sums
        self.largest = max(map(abs, sums), default=0)

    def away(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums``: long numbers, or Python's where those could overflow."""
        if self.n * int(np.abs(x).max(initial=0)) + self.largest < 1 << 62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.away(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        away = self.away(x)
        if away.dtype == object or int(np.abs(away).max(initial=0)) ** 2 * away.shape[1] >= 1 << 63:
            found = [sum(int(v) ** 2 for v in row) for row in away]
            return [v if v < 1 << 63 else None for v in found]
        return (away * away).sum(axis=1).tolist()


def _centre(fit: DataFrame, size: int) -> Centre:
    """Count and sums; high and low bits are summed apart, so that no sum overflows."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(size, np.int64), np.zeros(size, np.int64)
        for _, x in _matrices(batches, size):
            n += len(x)
            high += (x >> LOW_BITS).sum(axis=0)
            low += (x & (1 << LOW_BITS) - 1).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(size), pa.int32()), "n": [n] * size, "high": high, "low": low})

    found = fit.mapInArrow(sums, "i int, n long, high long, low long").groupBy("i")
    found = found.agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).orderBy("i").collect()
    return Centre(found[0]["n"], [(r["high"] << LOW_BITS) + r["low"] for r in found])  # a row for each dimension


def _packed(part: int, found: Spectrum) -> dict:
    arrays = {"mean": found.mean, "eigenvalues": found.values, "eigenvectors": found.vectors}
    return {"part": part, "n": found.n} | {k: np.ascontiguousarray(v).tobytes() for k, v in arrays.items()}


def _unpacked(row, size: int) -> Spectrum:
    mean, values, vectors = (np.frombuffer(b) for b in (row.mean, row.eigenvalues, row.eigenvectors))
    return Spectrum(int(row.n), mean, values, vectors.reshape(size, size))


def merged_spectrum(fit: DataFrame, centre: Centre, size: int) -> Spectrum:
    """The spectrum of all vectors: one for each part, then groups of ``FAN_IN`` merged until one is left."""
    parts = min(MAX_PARTS, ceil(centre.n / PART_ROWS))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, part = Spectrum.empty(size), 0
        for batch, x in _matrices(batches, size):
            part = batch.column("part")[0].as_py()
            for row in centre.centred(x):
                found.add(row)
        if found.n:
            yield pa.RecordBatch.from_pylist([_packed(part, found)])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        found = Spectrum.empty(size)
        for row in rows.sort_values("part").itertuples():
            found.merge(_unpacked(row, size))
        return pd.DataFrame([_packed(int(rows["part"].min()), found)])

    keyed = fit.withColumn("part", F.pmod(F.xxhash64("x"), F.lit(parts)))
    # a task may have several keys; one of them names its spectrum
    spectra = stage(keyed.repartition(parts, "part").mapInArrow(add, _SPECTRUM), "whitening-spectra")
    left, reach, merged = parts, FAN_IN, spectra
    while left > 1:
        group = F.floor(F.col("part") / reach).alias("merging")
        merged = merged.groupBy(group).applyInPandas(merge, _SPECTRUM)
        left, reach = ceil(left / FAN_IN), reach * FAN_IN
    found = _unpacked(merged.first(), size)
    discard(spectra)
    return found


def _summed(fit: DataFrame, size: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all vectors of the numbers that ``of`` makes of a matrix of vectors."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _matrices(batches, size):
            made = of(x)
            total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(total.size), pa.int32()), "total": total.ravel()})

    found = fit.mapInArrow(partial, "i int, total double").groupBy("i").agg(F.sum("total").alias("total"))
    table = found.toArrow().sort_by("i")  # as many rows as ``of`` makes numbers
    return table["total"].to_numpy()


class Components:
    """Unit eigenvectors as columns, by falling eigenvalue, and what share of the variance each explains."""

    def __init__(self, vectors: np.ndarray, values: np.ndarray, explained: np.ndarray) -> None:
        self.vectors, self.values, self.explained = vectors, values, explained

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.vectors / np.sqrt(self.values)


def refined(fit: DataFrame, centre: Centre, basis: np.ndarray, wanted: int) -> Components:
    """Rayleigh-Ritz: eigenvectors of the covariance within the span of ``basis``.

    Directions without variance, as far as doubles tell, are left out. Of both signs
    the one with the entry of largest size positive is taken.
    """
    size = len(basis)
    basis = np.linalg.qr(basis)[0]

    def covariance(x: np.ndarray) -> np.ndarray:
        turned = centre.centred(x) @ basis
        return turned.T @ turned

    within = _summed(fit, size, covariance).reshape(size, size) / centre.n
    values, turn = np.linalg.eigh((within + within.T) / 2)
    keep = np.argsort(-values, kind="stable")[:wanted]
    keep = keep[values[keep] > size * EPS * max(values.max(), 0)]
    vectors = basis @ turn[:, keep]
    vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(keep))])
    return Components(vectors, values[keep], values[keep] / np.trace(within))


def identity_error(fit: DataFrame, centre: Centre, components: Components) -> float:
    """Largest entry, in size, of the covariance of the whitened fit list minus the identity."""
    k = len(components.values)

    def moments(x: np.ndarray) -> np.ndarray:
        white = components.whitened(centre.centred(x))
        return np.concatenate([white.sum(axis=0), (white.T @ white).ravel()])

    found = _summed(fit, len(components.vectors), moments) / centre.n
    return float(np.abs(found[k:].reshape(k, k) - np.outer(found[:k], found[:k]) - np.eye(k)).max())


def whitened(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every usable row and component.

    A row is left out if its vector is null, empty or shorter than the longest one, or
    has an entry that is null, not finite or 2**46 or larger in size. Entries become
    whole numbers; equal vectors count once in the fit but every row is returned, with
    its id, null or repeated as it is. A deviation that fits no long is null. There are
    no more components than directions with variance: none, and so no rows, if all
    vectors are equal. Other columns play no part. The driver and every task hold square
    matrices of the vector length, whatever the number of rows.
    """
    spark = rows.sparkSession
    whole = rows.where(usable(F.col(vector_col), SCALE)).select(
        F.col(id_col).cast("long").alias("vec_id"), whole_entries(F.col(vector_col), SCALE, OFFSET).alias("x")
    )
    whole, size = of_full_length(whole, "x")
    nothing = spark.createDataFrame([], _RESULT)
    if not size:
        return nothing
    fit = stage(whole.select("x").distinct(), "whitening-fit")
    centre = _centre(fit, size)
    found = refined(fit, centre, merged_spectrum(fit, centre, size).vectors, components)
    k = len(found.values)
    if not k:
        return nothing
    error = identity_error(fit, centre, found)
    discard(fit)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _matrices(batches, size):
            at = pa.array(np.repeat(np.arange(len(x)), k))
            n = len(at)
            columns = [
                batch.column("vec_id").take(at),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(n, centre.n)),
                pa.array(centre.deviations(x), pa.int64()).take(at),
                pa.array(found.whitened(centre.centred(x)).ravel()),
                pa.array(np.tile(found.explained, len(x))),
                pa.array(np.full(n, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _RESULT.split(", ")])

    return whole.mapInArrow(project, _RESULT)
