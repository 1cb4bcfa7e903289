"""Seasonal and annual profiles, and the text and axes figures need."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackuse.operators.ordering import with_rank
from trackuse.operators.usage import SITE, complete_days, tracked_by_cycle
from trackuse.sources.staging import stage


def occupancy(clean: DataFrame) -> DataFrame:
    """Share of the calendar year's animals present on each day of the year."""
    # both counts below come from this one table
    seen = stage(
        clean.select(
            F.year("date").alias("year"), F.dayofyear("date").alias("doy"), "local_identifier"
        ).distinct(),
        "days-seen",
    )
    daily = seen.groupBy("year", "doy").agg(F.count("*").alias("n_present"))
    yearly = (
        seen.select("year", "local_identifier").distinct().groupBy("year").agg(F.count("*").alias("n_tracked"))
    )
    # one row per calendar year
    return daily.join(F.broadcast(yearly), "year", "left").withColumn(
        "prop_present", F.try_divide("n_present", "n_tracked")
    )


def occupancy_roll14(occ: DataFrame, rows: int = 14) -> DataFrame:
    """Mean occupancy per day of year with its sum over the last ``rows`` rows.

    At most 366 rows reach the window, so it needs no partition key.
    """
    w = Window.orderBy("doy").rowsBetween(1 - rows, 0)
    mean = occ.groupBy("doy").agg(F.avg("prop_present").alias("mean_prop_present"))
    full = F.count("*").over(w) == rows
    return mean.withColumn("roll_14", F.when(full, F.sum("mean_prop_present").over(w)))


def seasonal_profile(presence: DataFrame, sites: DataFrame, days: int = 366) -> DataFrame:
    """Mean daily share per site over cycles with presence that day, else 0.

    ``site_order`` ranks sites from north to south.
    """
    # presence has one row per animal, site and day
    daily = presence.groupBy("nb_year", *SITE, "day_in_year").agg(F.count("*").alias("n_present"))
    # one row per calendar year
    share = daily.join(F.broadcast(tracked_by_cycle(presence, "n_tracked")), "nb_year", "left")
    mean = (
        share.withColumn("prop_present", F.try_divide("n_present", "n_tracked"))
        .groupBy(*SITE, "day_in_year")
        .agg(F.avg("prop_present").alias("prop"))
    )
    # rounded so that equal latitudes tie, then by number
    north = [F.desc(F.round("latitude", 9)), F.col("site_id").asc()]
    order = with_rank(sites.select("site_id", "latitude"), north, "site_order").drop("latitude")
    return complete_days(mean, SITE, "prop", F.lit(0.0), days).join(order, "site_id", "left")


def annual_use_order(use: DataFrame) -> DataFrame:
    """Yearly shares with ``site_order``, sites ranked by mean share."""
    means = use.groupBy("site_label").agg(F.avg("prop_site").alias("mean_prop"))
    # rounded so that equal means tie whatever the sum order
    order = with_rank(means, [F.desc(F.round("mean_prop", 12)), F.col("site_label").asc()], "site_order")
    return use.join(order, "site_label")


def axis_breaks(df: DataFrame, col: str = "nb_year", step: int = 2) -> DataFrame:
    """Axis ticks from the smallest to the largest value."""
    ends = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    return ends.select(F.explode(F.sequence("lo", "hi", F.lit(step))).alias("axis_break"))


def map_labels(summary: DataFrame) -> DataFrame:
    """Add ``label``, such as ``Saloum Delta: 12%``; halves round to even."""
    percent = F.rint(F.col("prop_mean") * 100).cast("int").cast("string")
    return summary.withColumn("label", F.concat("site_label", F.lit(": "), percent, F.lit("%")))
