"""Hard negatives of anchor vectors, with exact scores from a residue number system.

Scores are inner products of whole numbers. Matrices are multiplied modulo several
small primes in float32, small enough that no sum is rounded, and the Chinese remainder
theorem puts the signed scores together. Anchors are a stated set of queries: every one
meets all rows, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackuse.llm.vectors import of_full_length, usable, whole_entries
from trackuse.sources.staging import discard, stage

SCALE = 256
NEAREST = 5
ANCHORS_EVERY = 100
EXACT = 1 << 24  # float32 holds all whole numbers up to here
COLUMNS = 64  # of the vectors, multiplied at once
LARGEST_BLOCK, LEAST_BLOCK = 65_536, 2_048  # rows that an anchor meets at once
TILE = 1 << 22  # scores that are made at once


def _primes(limit: int, n: int) -> list[int]:
    """The ``n`` largest primes up to ``limit``."""
    found: list[int] = []
    for p in range(limit, 2, -1):
        if all(p % q for q in range(2, int(p**0.5) + 1)):
            found.append(p)
            if len(found) == n:
                break
    return found


class Residues:
    """Exact inner products up to ``bound`` in size of whole-number vectors."""

    def __init__(self, bound: int) -> None:
        half = int((EXACT / COLUMNS) ** 0.5)  # residues up to this size: COLUMNS products never pass EXACT
        n = 1
        while prod(primes := _primes(2 * half - 1, n)) <= 2 * bound:
            n += 1
        self.primes = primes

    def split(self, x: np.ndarray) -> list[np.ndarray]:
        """For each prime the signed residues of smallest size, as float32."""
        return [((x + p // 2) % p - p // 2).astype(np.float32) for p in self.primes]

    def scores(self, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        """The inner products of all rows of both matrices, given by their residues."""
        total, weight = np.zeros((len(a[0]), len(b[0])), np.int64), 1
        for x, y, p in zip(a, b, self.primes, strict=True):
            rest = np.zeros_like(total)
            for at in range(0, x.shape[1], COLUMNS):
                rest += (x[:, at : at + COLUMNS] @ y[:, at : at + COLUMNS].T).astype(np.int64)
            # mixed radix: the next digit, signed and of smallest size
            digit = (rest - total) % p * pow(weight, -1, p) % p
            # long numbers wrap, and the score itself fits one
            total += np.where(digit > p // 2, digit - p, digit) * np.uint64(weight % (1 << 64)).astype(np.int64)
            weight *= p
        return total


def first_of_each(groups: np.ndarray, n: int) -> np.ndarray:
    """Which of the rows, sorted by group, are among the first ``n`` of theirs."""
    return np.arange(len(groups)) - np.searchsorted(groups, groups) < n


def _ranked(scores: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The wanted places of a score matrix as row, column and score, by row, falling score and column."""
    i, j = np.nonzero(wanted)
    s = scores[i, j]
    order = np.lexsort((j, -s, i))
    return i[order], j[order], s[order]


def best_alike(scores: np.ndarray, allowed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``n`` allowed columns of each row by falling score, then by column."""
    masked = np.where(allowed, scores, np.iinfo(np.int64).min)
    if masked.shape[1] > n:
        least = np.partition(masked, -n, axis=1)[:, -n]
        allowed = allowed & (masked >= least[:, None])
    i, j, s = _ranked(scores, allowed)
    keep = first_of_each(i, n)
    return i[keep], j[keep], s[keep]


def best_in_windows(
    scores: np.ndarray, allowed: np.ndarray, tops: np.ndarray, used: np.ndarray, n: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each window the first ``n`` allowed columns of each row with a score in it.

    Window k of row i reaches from 4/5 of ``tops[i, k]`` to all of it, where ``used[i, k]``.
    """
    bottoms = tops - tops // 5  # 4/5, rounded up
    open_ = used & (bottoms <= tops)
    widest = np.iinfo(np.int64)
    low = np.where(open_, bottoms, widest.max).min(axis=1, initial=widest.max)
    high = np.where(open_, tops, widest.min).max(axis=1, initial=widest.min)
    i, j, s = _ranked(scores, allowed & (scores >= low[:, None]) & (scores <= high[:, None]))
    for k in range(tops.shape[1]):
        inside = open_[i, k] & (s >= bottoms[i, k]) & (s <= tops[i, k])
        a, b, c = i[inside], j[inside], s[inside]
        keep = first_of_each(a, n)
        yield k, a[keep], b[keep], c[keep]


def _rows(batch: pa.RecordBatch, size: int) -> dict[str, np.ndarray]:
    plain = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "class", "copy")}
    return plain | {"x": batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)}


class _Block:
    """The rows that anchors meet, in the order in which ties are decided."""

    def __init__(self, parts: list[dict[str, np.ndarray]], residues: Residues) -> None:
        whole = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
        order = np.lexsort((whole["copy"], whole["vec_id"]))
        self.ids, self.classes, self.copies = (whole[c][order] for c in ("vec_id", "class", "copy"))
        self.residues = residues.split(whole["x"][order])


def _meetings(
    batches: Iterator[pa.RecordBatch], size: int, residues: Residues
) -> Iterator[tuple[_Block, pa.RecordBatch, dict[str, np.ndarray], np.ndarray]]:
    """Each block with slices of its anchors and their scores. The rows of a block come before its anchors."""
    block, parts, number = None, [], None
    for batch in batches:
        numbers = batch.column("block").to_numpy()
        kinds = batch.column("is_anchor").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(kinds.astype(np.int8)) != 0)) + 1
        for a, b in zip([0, *edges], [*edges, len(numbers)], strict=True):
            if numbers[a] != number:
                block, parts, number = None, [], numbers[a]
            if not kinds[a]:
                parts.append(_rows(batch.slice(a, b - a), size))
                continue
            if block is None and parts:
                block, parts = _Block(parts, residues), []
            if block is None:
                continue
            step = max(1, TILE // len(block.ids))
            for at in range(a, b, step):
                part = batch.slice(at, min(step, b - at))
                anchors = _rows(part, size)
                yield block, part, anchors, residues.scores(residues.split(anchors["x"]), block.residues)


_FOUND = "anchor_id long, anchor_copy int, window int, vec_id long, copy int, score long"


def _found(anchors: dict, block: _Block, window: int, i: np.ndarray, j: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "anchor_id": anchors["vec_id"][i],
            "anchor_copy": pa.array(anchors["copy"][i], pa.int32()),
            "window": pa.array(np.full(len(i), window), pa.int32()),
            "vec_id": block.ids[j],
            "copy": pa.array(block.copies[j], pa.int32()),
            "score": s,
        }
    )


def _met(rows: DataFrame, anchors: DataFrame, blocks: int, find) -> DataFrame:
    """What ``find`` makes of every block of rows and all anchors; an anchor is sent once to each block."""
    number = F.pmod(F.xxhash64("vec_id", "copy"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    sides = rows.select("*", number.alias("block"), F.lit(False).alias("is_anchor")).unionByName(
        anchors.select("*", every.alias("block"), F.lit(True).alias("is_anchor")), allowMissingColumns=True
    )
    return sides.repartition(blocks, "block").sortWithinPartitions("block", "is_anchor").mapInArrow(find, _FOUND)


def _first(found: DataFrame, keys: list[str], n: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "copy")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def shifted_label(label: Column, vec_id: Column) -> Column:
    """The label, moved on by one of ten where the id is divisible by 7."""
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


def mined(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", nearest: int = NEAREST
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id is divisible by 100, its positives the first ``nearest``
    other rows of its label by score, its negatives for each positive the first
    ``nearest`` rows of other labels with a score between 4/5 of the positive's and all of it.

    A row takes no part if its id, label or vector is null, the vector is empty or
    shorter than the longest one, or has an entry that is null or not finite, or if its
    scores might fit no long (a sum of squares of 2**62 or more). Equal rows count once; rows that share an
    id but differ are told apart and ordered by label and vector, and an anchor never meets rows
    of its own id. Ties go to the smaller id. Other columns play no part.
    """
    vec_id = F.col(id_col).cast("long")
    usable_rows = rows.where(usable(F.col(vector_col), SCALE) & vec_id.isNotNull() & F.col(label_col).isNotNull()).select(
        vec_id.alias("vec_id"),
        shifted_label(F.col(label_col).cast("long"), vec_id).alias("class"),
        whole_entries(F.col(vector_col), SCALE).alias("x"),
    )
    squares = F.aggregate("x", F.lit(0.0), lambda total, v: total + v.cast("double") * v.cast("double"))
    usable_rows, size = of_full_length(usable_rows.where(squares < 2.0**62), "x")
    if not size:
        return rows.sparkSession.createDataFrame([], _RESULT)
    same_id = Window.partitionBy("vec_id").orderBy("class", "x")
    distinct = usable_rows.repartition("vec_id").distinct()
    table = stage(distinct.withColumn("copy", F.row_number().over(same_id)), "negatives-rows")
    n, longest = table.agg(F.count("*"), F.max(squares)).first()
    residues = Residues(int(longest * 1.001) + 1)  # no score is larger in size than the largest sum of squares
    parallel = rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(ceil(n / LARGEST_BLOCK), min(3 * parallel, ceil(n / LEAST_BLOCK)))
    anchors = table.where(F.col("vec_id") % ANCHORS_EVERY == 0)

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, own, scores in _meetings(batches, size, residues):
            same = (own["class"][:, None] == block.classes) & (own["vec_id"][:, None] != block.ids)
            yield _found(own, block, 0, *best_alike(scores, same, nearest))

    positives = _first(_met(table, anchors, blocks, alike), ["anchor_id", "anchor_copy"], nearest)
    positives = stage(positives.drop("window"), "negatives-positives")
    tops = positives.groupBy(F.col("anchor_id").alias("vec_id"), F.col("anchor_copy").alias("copy")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda p: p["score"]).alias("tops")
    )

    def unlike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part, own, scores in _meetings(batches, size, residues):
            other = own["class"][:, None] != block.classes
            lists = part.column("tops").to_pylist()
            used = np.array([[k < len(t) for k in range(nearest)] for t in lists])
            tops = np.array([[*t, *[0] * (nearest - len(t))] for t in lists], np.int64)
            for window in best_in_windows(scores, other, tops, used, nearest):
                yield _found(own, block, *window)

    with_tops = stage(anchors.join(tops, ["vec_id", "copy"]), "negatives-anchors")
    negatives = _first(_met(table, with_tops, blocks, unlike), ["anchor_id", "anchor_copy", "window"], nearest)
    negatives = stage(
        negatives.select(
            "anchor_id", "anchor_copy", (F.col("window") + 1).alias("window"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")
        ),
        "negatives-found",
    )
    discard(table)
    discard(with_tops)
    named = positives.select(
        "anchor_id", "anchor_copy", F.col("rank").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return negatives.join(named, ["anchor_id", "anchor_copy", "window"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"

SQL = """
WITH used AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS class,
         [CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0
),
scores AS (
  SELECT a.vec_id AS anchor_id, a.class = o.class AS alike, o.vec_id,
         CAST(list_inner_product(CAST(a.x AS DOUBLE[]), CAST(o.x AS DOUBLE[])) AS BIGINT) AS score
  FROM used a JOIN used o ON a.vec_id <> o.vec_id
  WHERE a.vec_id % 100 = 0
),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM scores WHERE alike)
  WHERE place <= 5
),
windowed AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS place
  FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id
  WHERE NOT s.alike AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM windowed WHERE place <= 5
"""
