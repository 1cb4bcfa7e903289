"""Example routes: one bird per tagging site, one fix per day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackuse.fixed_values import TAG_SITE_RULES
from trackuse.functions.season import as_utc
from trackuse.operators.clean import require_values, time_range
from trackuse.operators.ordering import first_n_per_group, same_key

ID = "individual_local_identifier"


def tag_site(rules: Sequence[tuple[str, str, str, str]] = TAG_SITE_RULES) -> Column:
    """Tagging site by the first rule that holds; a null input fails its rule."""
    site = F.lit(None).cast("string")
    for column, kind, value, name in reversed(rules):
        holds = F.col(column).rlike(f"(?i){value}") if kind == "pattern" else F.col(column) == value
        site = F.when(holds, name).otherwise(site)
    return site


def first_daily_fix(df: DataFrame, start: str, end: str) -> DataFrame:
    """Earliest located fix per animal and day, strictly inside the period."""
    timed = df.withColumn("timestamp", as_utc(df, "timestamp"))
    inside = time_range(require_values(timed, ["X", "Y"]), "timestamp", start, end, closed="neither")
    dated = inside.withColumn("date", F.to_date("timestamp"))
    return first_n_per_group(dated, [ID, "date"], ["timestamp"], 1)


def with_tag_site(daily: DataFrame, rules: Sequence[tuple[str, str, str, str]] = TAG_SITE_RULES) -> DataFrame:
    """Add each animal's first known tagging site; animals without one are dropped.

    ``daily`` has one row per animal and day, so the per-animal window is limited
    by the days of the period.
    """
    w = (
        Window.partitionBy(ID)
        .orderBy("timestamp")
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    first = F.first(tag_site(rules), ignorenulls=True).over(w)
    return daily.withColumn("tag_site", first).filter(F.col("tag_site").isNotNull())


def representative_bird(daily: DataFrame) -> DataFrame:
    """Animal with the most days per tagging site; ties by identifier."""
    days = daily.groupBy("tag_site", ID).agg(F.count("*").alias("n_days"))
    most = Window.partitionBy("tag_site").orderBy(F.desc("n_days"), F.col(ID).asc_nulls_last())
    return days.withColumn("_rank", F.row_number().over(most)).filter("_rank = 1").drop("_rank")


def routes(
    df: DataFrame,
    start: str = "2021-06-01",
    end: str = "2022-06-01",
    rules: Sequence[tuple[str, str, str, str]] = TAG_SITE_RULES,
) -> DataFrame:
    """One line per tagging site: points of the chosen bird in time order.

    A line has at most one point per day of the period.
    """
    daily = with_tag_site(first_daily_fix(df, start, end), rules)
    chosen = representative_bird(daily).select(F.col("tag_site").alias("_site"), F.col(ID).alias("_id"))
    pairs = [("tag_site", "_site"), (ID, "_id")]
    point = F.struct(F.col("timestamp").alias("ts"), F.col("X").alias("x"), F.col("Y").alias("y"))
    # one chosen bird per rule, so at most len(rules) rows
    return (
        daily.join(F.broadcast(chosen), same_key(daily, chosen, pairs))
        .groupBy("tag_site", ID)
        .agg(F.array_sort(F.collect_list(point)).alias("route"))
    )
