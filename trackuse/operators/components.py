"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackuse.sources.staging import discard, stage


def connected_components(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, label`` for every node that has a link to another one; nodes with one label are connected.

    Randomised contraction: in each round the nodes get a new random order, every
    node joins the smallest of itself and its neighbours, and the links between the
    joined nodes go to the next round. A constant share of the nodes is expected to
    vanish per round whatever the shape, so the rounds grow with the logarithm of
    the number of nodes. Links are combined before they are shuffled, a hub is split
    by the skew joins of adaptive execution, and each round is staged. Loops and
    repeated links change nothing; links with a null end are left out.
    """
    rest = stage(_distinct(links.select(F.col(src).alias("a"), F.col(dst).alias("b"))), "links")
    rounds: list[DataFrame] = []
    while not rest.isEmpty():
        rank = lambda c, salt=len(rounds): F.struct(F.xxhash64(F.lit(salt), c).alias("rank"), c.alias("node"))
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("least"))
        own = rank(F.col("a"))
        into = F.when(own < F.col("least"), F.col("a")).otherwise(F.col("least").getField("node"))
        joined = stage(least.select(F.col("a").alias("node"), into.alias("into")), "joined")
        ends = (
            rest.join(joined.select(F.col("node").alias("a"), F.col("into").alias("x")), "a")
            .join(joined.select(F.col("node").alias("b"), F.col("into").alias("y")), "b")
            .select(F.col("x").alias("a"), F.col("y").alias("b"))
        )
        following = stage(_distinct(ends), "links")
        discard(rest)
        rest = following
        rounds.append(joined)
    discard(rest)
    if not rounds:
        return links.select(F.col(src).alias("node"), F.col(src).alias("label")).limit(0)
    labels = rounds[-1].select("node", F.col("into").alias("label"))
    for joined in reversed(rounds[:-1]):
        later = labels.select(F.col("node").alias("into"), "label")
        labels = joined.join(later, "into", "left").select("node", F.coalesce("label", "into").alias("label"))
    return labels


def _distinct(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
