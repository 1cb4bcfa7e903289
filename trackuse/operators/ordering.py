"""Total row orders and first-n selection shared by several operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackuse.sources.staging import stage


def total_order(df: DataFrame, order: Sequence[str], skip: Sequence[str] = ()) -> list[Column]:
    """``order``, then every other sortable column by name, nulls last.

    Spark keeps no input order, so ties need a rule: with all columns in the
    order only fully equal rows are left, and any of those will do.
    """
    rest = sorted(
        f.name
        for f in df.schema.fields
        if f.name not in order
        and f.name not in skip
        and not isinstance(f.dataType, (T.MapType, T.VariantType))
    )
    return [F.col(f"`{c}`").asc_nulls_last() for c in [*order, *rest]]


def first_n_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int
) -> DataFrame:
    """First ``n`` rows of each group.

    The filter on ``row_number`` becomes a window group limit: every map task
    keeps at most ``n`` rows per group before the shuffle, so one huge group
    does not reach a single task whole.
    """
    w = Window.partitionBy(*keys).orderBy(*total_order(df, order, skip=keys))
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def with_rank(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Add the place of each row in a total order, counted from 1.

    Rows are sorted into ranges; a range starts after the rows of the ranges
    before it. Only the sizes of the ranges, one row each, meet in one task.
    """
    ranged = stage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").count()
    starts = sizes.select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.join(starts, "_range").withColumn(name, (F.col("_before") + place).cast("int")).drop("_range", "_before")


def same_key(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    """Equality on key pairs where null equals null."""
    cond = None
    for a, b in pairs:
        c = left[a].eqNullSafe(right[b])
        cond = c if cond is None else cond & c
    return cond


def no_nan(df: DataFrame, name: str) -> Column:
    """Column with ``NaN`` turned to null, for floating columns."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(F.col(f"`{name}`")), F.col(f"`{name}`"))
    return F.col(f"`{name}`")
