"""Outliers against a centred rolling mean."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackuse.operators.ordering import same_key, total_order
from trackuse.sources.staging import stage


LARGE = 250_000  # rows from which a key is cut into slices


def _with_slices(df: DataFrame, key: str, order: Sequence[str], half: int, slices: int) -> DataFrame:
    """Rows in even ranges of key and order, each lent ``half`` rows by its neighbours.

    Adds ``_slice`` and ``_extra`` (a lent row). Ranges are cut wherever the rows
    lie, by all columns, so neither one long individual nor one busy hour nor
    missing times make a large slice.
    """
    asc = total_order(df, order, skip=[key])
    ranged = df.repartitionByRange(slices, F.col(key).asc_nulls_last(), *asc)
    rows = stage(ranged.withColumn("_slice", F.spark_partition_id()), "outlier-slices")
    up = Window.partitionBy(key, "_slice").orderBy(*asc)
    size = F.count("*").over(Window.partitionBy(key, "_slice"))
    ends = (
        rows.withColumn("_up", F.row_number().over(up))
        .withColumn("_down", size - F.col("_up") + 1)
        .filter((F.col("_up") <= half) | (F.col("_down") <= half))
    )
    # Slice ends only: a few rows per slice, so one task per individual is fine.
    along = Window.partitionBy(key).orderBy(*asc)
    row = F.struct(*df.columns)
    lent = []
    for k in range(1, half + 1):
        lent.append(F.when(F.col("_up") == 1, F.lag(row, k).over(along)))
        lent.append(F.when(F.col("_down") == 1, F.lead(row, k).over(along)))
    extra = (
        ends.select("_slice", F.array_compact(F.array(*lent)).alias("_lent"))
        .select("_slice", F.inline("_lent"))
        .withColumn("_extra", F.lit(True))
    )
    return rows.withColumn("_extra", F.lit(False)).unionByName(extra)


def _cut(df: DataFrame, key: str, order: Sequence[str], half: int, slices: int) -> DataFrame:
    """Rows of keys with more than ``LARGE`` rows in slices, all other keys whole, as one slice each."""
    sizes = df.groupBy(F.col(key).alias("_large")).agg(F.count("*").alias("_rows"))
    large = stage(sizes.where(F.col("_rows") > LARGE).select("_large"), "outlier-keys")  # few rows, so Spark broadcasts them
    whole = lambda rows: rows.withColumn("_slice", F.lit(-1)).withColumn("_extra", F.lit(False))
    if large.isEmpty():
        return whole(df)
    met = same_key(df, large, [(key, "_large")])
    return whole(df.join(large, met, "left_anti")).unionByName(_with_slices(df.join(large, met, "left_semi"), key, order, half, slices))


def flag_outliers(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    cols: Sequence[str],
    width: int = 5,
    limit: float = 10.0,
    slices: int | None = None,
) -> DataFrame:
    """Add rolling mean, sd and squared deviation over sd per column, and a flag.

    ``order[0]`` is the time column. The flag is null when any window is not
    full or has no spread. The rows of large keys are cut into overlapping ranges of
    even size, as many as shuffle partitions; with ``slices`` the whole table is cut into that many. The result does not
    depend on it. Counting the keys and finding the ranges takes passes of their own, so stage
    ``df`` if it is costly to compute.
    """
    half = width // 2
    names = df.columns
    if slices:
        rows = _with_slices(df, key, order, half, slices)
    else:
        rows = _cut(df, key, order, half, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asc = total_order(df, order, skip=[key])
    w = Window.partitionBy(key, "_slice").orderBy(*asc).rowsBetween(-half, half)
    full = {c: F.count(c).over(w) == width for c in cols}
    stats = rows.select(
        "*",
        *[F.when(full[c], F.avg(c).over(w)).alias(f"{c}_mean_{width}") for c in cols],
        *[F.when(full[c], F.stddev_samp(c).over(w)).alias(f"{c}_sd_{width}") for c in cols],
    ).filter(~F.col("_extra"))
    bad = F.lit(False)
    for c in cols:
        gap = F.col(c) - F.col(f"{c}_mean_{width}")
        stats = stats.withColumn(f"{c}_dev", F.try_divide(gap * gap, F.col(f"{c}_sd_{width}")))
        # NaN compares above every number in Spark; here it must stay unknown
        bad = bad | (F.when(~F.isnan(f"{c}_dev"), F.col(f"{c}_dev")) > limit)
    return stats.withColumn("outlier", F.when(bad, "outlier").when(~bad, "normal")).select(
        *[F.col(f"`{c}`") for c in names],
        *[f"{c}_{m}" for c in cols for m in (f"mean_{width}", f"sd_{width}", "dev")],
        "outlier",
    )


def drop_outliers(df: DataFrame) -> DataFrame:
    """Rows flagged normal; unknown flags go too."""
    return df.filter(F.col("outlier") == "normal")
