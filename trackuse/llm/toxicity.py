"""Toxicity of texts: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

BITS = 18
ORDERS = (3, 4, 5)
THRESHOLD = 0.3
MAX_ROWS = 8_000
MIN_TEXTS = 4
MIN_RATIO = 1.0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def ngrams(text: str | None) -> np.ndarray:
    """Hash buckets of all character n-grams of the lower-case text, white space as one space."""
    spaced = f" {' '.join((text or '').lower().split())} "
    codes = np.frombuffer(spaced.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    hashes, found = codes, []
    for n in range(2, max(ORDERS) + 1):
        if len(codes) < n:
            break
        hashes = hashes[: len(codes) - n + 1] * _BASE + codes[n - 1 :]
        if n in ORDERS:
            found.append((hashes * _MIX >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Model:
    """``weights`` of the hash buckets, the ratios included, zero for a bucket that is not used."""

    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        grams = ngrams(text)
        used = np.unique(grams[self.weights[grams] != 0])
        return float(1 / (1 + np.exp(-(self.bias + self.weights[used].sum() * scale(len(grams))))))


def scale(n: int) -> float:
    return 10 / max(n, 1) ** 0.5


def training_rows(docs: DataFrame, labels: DataFrame, allowed: Column, max_rows: int) -> DataFrame:
    """``text, toxic`` of at most ``max_rows`` labelled ids, chosen by the hash of the id."""
    ids = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & allowed)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # bounded by max_rows
    return found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            counts[int(toxic), np.unique(ngrams(text))] += 1
    seen = np.flatnonzero(counts.any(axis=0))
    yield pd.DataFrame({"bucket": seen, "clean": counts[0, seen], "toxic": counts[1, seen]})


def _features(ratios: np.ndarray):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                grams = ngrams(text)
                out.append((int(toxic), scale(len(grams)), np.unique(grams[ratios[grams] != 0]).tolist()))
            yield pd.DataFrame(out, columns=["toxic", "scale", "buckets"])

    return rows


def train(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most ``max_rows`` labelled texts, of those rows of ``labels`` that are ``allowed``.

    A bucket counts once per text. It is used if at least ``MIN_TEXTS`` texts have it
    and the smoothed share of toxic texts with it and that of clean texts differ by a
    factor e**``MIN_RATIO``; the log of that factor scales it. Labels other than 0 and 1
    are left out, and of different labels of an id the larger counts. With no text of
    one class every score is 0.
    """
    rows = training_rows(docs, labels, F.lit(True) if allowed is None else allowed, max_rows)
    total = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}  # two rows
    if len(total) < 2:
        return Model(np.zeros(1 << BITS), -np.inf)
    counted = (
        rows.mapInPandas(_count, "bucket long, clean long, toxic long")
        .groupBy("bucket")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where(F.col("clean") + F.col("toxic") >= MIN_TEXTS)
    )
    ratio = F.log((F.col("toxic") + 1) / total[1]) - F.log((F.col("clean") + 1) / total[0])
    chosen = counted.select("bucket", ratio.alias("ratio")).where(F.abs("ratio") >= MIN_RATIO).toArrow()
    ratios = np.zeros(1 << BITS)  # at most this many rows come
    ratios[chosen["bucket"].to_numpy()] = chosen["ratio"].to_numpy()
    sample = rows.mapInPandas(_features(ratios), "toxic int, scale double, buckets array<int>").toArrow().to_pandas()
    return _fit(sample, ratios)


def _fit(sample: pd.DataFrame, ratios: np.ndarray, rounds: int = 200, rate: float = 0.1, decay: float = 1e-5) -> Model:
    """Logistic regression with adaptive steps over the whole bounded sample."""
    order = sample.assign(key=sample["buckets"].map(tuple)).sort_values(["key", "toxic"])
    sizes = order["buckets"].map(len).to_numpy()
    y = order["toxic"].to_numpy(float)
    row = np.repeat(np.arange(len(y)), sizes)
    col = np.concatenate([np.asarray(b, np.int64) for b in order["buckets"]]) if sizes.sum() else np.zeros(0, np.int64)
    x = ratios[col] * np.repeat(order["scale"].to_numpy(), sizes)
    w, b = np.zeros(1 << BITS), 0.0
    seen, seen_b = np.full(1 << BITS, 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(row, x * w[col], minlength=len(y)) + b
        miss = (1 / (1 + np.exp(-z)) - y) / len(y)
        step = np.bincount(col, x * miss[row], minlength=1 << BITS) + decay * w
        seen += step**2
        seen_b += miss.sum() ** 2
        w -= rate * step / np.sqrt(seen)
        b -= rate * miss.sum() / np.sqrt(seen_b)
    return Model(w * ratios, b)


def score_of(model: Model):
    """A column function that scores a column of texts; a null text counts as empty."""

    @F.pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            return pd.Series([model.score(t) for t in texts], dtype="float64")

    return score


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fourth of the ids that is never trained on."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, by a model that never saw the held-out ids."""
    score = score_of(train(docs, labels, ~held_out()))
    out = docs.select("doc_id", held_out().alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns as they are."""
    score = score_of(train(docs, labels, ~held_out()))
    return docs.where(score("text") < THRESHOLD)
