"""Context-triggered piecewise hashes of documents, and their likeness.

A rolling hash over seven bytes ends a chunk where its low bits are all ones, so
chunk ends depend on their context only. A fingerprint is ``k:first:second``: the
chunk codes at block size 2**k and at the next one, two letters a chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
WINDOW = 7
CHUNKS = 64
SMALLEST = 2
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as far as needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, np.uint64(base))
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def rolling_hashes(data: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Sums of weighted bytes before each position, and the mixed hash of the window that ends at each byte."""
    up, down = _POWERS.to(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down, out=sums[1:])
    rolled = sums[1:].copy()
    rolled[window:] -= sums[1:-window]
    rolled *= up
    rolled ^= rolled >> np.uint64(29)
    rolled *= _MIX
    return sums, rolled >> np.uint64(32)


def _codes(ends: np.ndarray, sums: np.ndarray, last: int) -> str:
    ends = ends[: CHUNKS - 1]
    if not len(ends) or ends[-1] != last:
        ends = np.append(ends, last)
    starts = np.concatenate(([0], ends[:-1] + 1))
    chunk = (sums[ends + 1] - sums[starts]) * _POWERS.up[ends]
    chunk ^= chunk >> np.uint64(31)
    chunk = (chunk * _MIX) >> np.uint64(52)
    return "".join([LETTERS[c >> 6] + LETTERS[c & 63] for c in chunk.tolist()])


def fingerprint(text: str | None) -> str:
    """``k:first:second``; equal texts have equal fingerprints, a null text that of the empty one.

    ``k`` starts where an even text has at most 64 chunks and falls until there are 32, to 2
    at the least. The last code stands for all that is left, so every byte counts.
    """
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return f"{SMALLEST}::"
    sums, rolled = rolling_hashes(data)
    k = max(SMALLEST, (max(len(data) - 1, 1) // CHUNKS).bit_length())
    while True:
        low = np.uint64((1 << k) - 1)
        ends = np.flatnonzero(rolled & low == low)
        if len(ends) >= CHUNKS // 2 or k == SMALLEST:
            break
        k -= 1
    above = np.uint64((2 << k) - 1)
    second = ends[rolled[ends] & above == above]
    last = len(data) - 1
    return f"{k}:{_codes(ends, sums, last)}:{_codes(second, sums, last)}"


def _pairs(codes: str) -> list[str]:
    return [codes[i : i + 2] for i in range(0, len(codes), 2)]


def _likeness(first: str, second: str) -> float:
    """1 - d/(m+n), d the edit distance with insertions and removals of chunk codes."""
    a, b = _pairs(first), _pairs(second)
    if not a or not b or not set(a) & set(b):
        return 0.0
    places: dict[str, int] = {}
    for i, code in enumerate(a):
        places[code] = places.get(code, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for code in b:
        hit = row & places.get(code, 0)
        row = (row + hit | row - hit) & full
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


def likeness(first: str, second: str) -> float:
    """0 to 1. Block sizes that differ by more than a factor of two can't be compared and give 0."""
    if first == second:
        return 1.0
    k, a1, a2 = first.split(":")
    m, b1, b2 = second.split(":")
    apart = int(m) - int(k)
    if apart == 0:
        return max(_likeness(a1, b1), _likeness(a2, b2))
    if apart == 1:
        return _likeness(a2, b1)
    if apart == -1:
        return _likeness(a1, b2)
    return 0.0


@F.pandas_udf(StringType())
def fingerprint_of(texts: pd.Series) -> pd.Series:
    """The fingerprint of a column of texts."""
    return texts.map(fingerprint, na_action=None)


@F.pandas_udf(DoubleType())
def likeness_of(first: pd.Series, second: pd.Series) -> pd.Series:
    """The likeness of two columns of fingerprints, null if one is null."""
    return pd.Series([None if a is None or b is None else likeness(a, b) for a, b in zip(first, second, strict=True)], dtype="float64")


def with_successors(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text, bucket, foreign``: documents by ranges of ids, with the next range's first document.

    Ranges come from quantiles of the ids alone. Texts are shuffled once; the document
    that follows the last one of a range goes to that range too, marked as foreign.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(rows.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)))
    inside = F.size(F.filter(F.lit(bounds or [0.0]), lambda b: b < F.col("doc_id")))
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(inside))
    heads = rows.groupBy("bucket").agg(F.max("doc_id").alias("head")).orderBy(F.desc("bucket")).collect()
    before = [(h["bucket"], h["head"], heads[i - 1]["bucket"]) for i, h in enumerate(heads)]
    first = spark.createDataFrame(before, "bucket int, head long, before int")  # one row for each range
    is_head = F.col("doc_id").eqNullSafe(F.col("head"))
    own = F.struct(F.col("bucket").alias("b"), F.lit(False).alias("f"))
    other = F.struct(F.col("before").alias("b"), F.lit(True).alias("f"))
    to = F.explode(F.when(is_head, F.array(own, other)).otherwise(F.array(own)))
    return rows.join(F.broadcast(first), "bucket").select("doc_id", "text", to.alias("to")).select(
        "doc_id", "text", F.col("to.b").alias("bucket"), F.col("to.f").alias("foreign")
    )


_EDITED = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("n_chars", LongType()),
        StructField("edited_sha256", StringType()),
        StructField("fingerprint", StringType()),
        StructField("edited_fingerprint", StringType()),
        StructField("near_edited", DoubleType()),
        StructField("near_next", DoubleType()),
    ]
)


def _edited_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    ahead = None  # the row that waits for its successor
    for batch in batches:
        out = []
        for doc_id, text, bucket, foreign in batch[["doc_id", "text", "bucket", "foreign"]].itertuples(index=False):
            own = fingerprint(text)
            if ahead is not None and ahead[2] == bucket:
                before, start, _, print_ = ahead
                half = len(start) // 2
                edited = start[: len(start) - half] + text[:half]
                changed = fingerprint(edited)
                sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((before, len(start), sha, print_, changed, likeness(print_, changed), likeness(print_, own)))
            ahead = None if foreign else (doc_id, text, bucket, own)
        frame = pd.DataFrame(out, columns=_EDITED.names)
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        yield frame


def half_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, one row for each row.

    The last half of the code points is replaced by the first ones of the next
    document, by descending id, then text; null ids come last, and the first document
    follows the last one. A null text counts as empty; a single row follows itself.
    """
    ranged = with_successors(docs, id_col, text_col)
    order = ["bucket", "foreign", F.desc_nulls_last("doc_id"), "text"]
    return ranged.repartition("bucket").sortWithinPartitions(*order).mapInPandas(_edited_rows, _EDITED)
