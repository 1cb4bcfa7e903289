"""Presence days, peak windows and proportional use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackuse.config import Config
from trackuse.functions.season import cycle_day_label, with_cycle, wrap_day

SITE = ("site_id", "site_name", "site_label")


def presence_days(fixes: DataFrame, cfg: Config = Config()) -> DataFrame:
    """One row per animal, site and date."""
    days = fixes.select("local_identifier", *SITE, "date").distinct()
    return with_cycle(days, "date", cfg.anchor_month, cfg.anchor_day).filter(
        F.col("day_in_year").between(1, cfg.cycle_days)
    )


def daily_users(presence: DataFrame, dense: bool = True, days: int = 366) -> DataFrame:
    """Animals per site, cycle and day; ``dense`` fills all days with 0.

    Presence holds one row per animal and day, so counting rows counts animals,
    an unnamed one included.
    """
    seen = presence.groupBy(*SITE, "nb_year", "day_in_year").agg(F.count("*").alias("n_users"))
    return complete_days(seen, [*SITE, "nb_year"], "n_users", F.lit(0).cast("bigint"), days) if dense else seen


def complete_days(
    df: DataFrame, keys: Sequence[str], value: str, fill, days: int = 366
) -> DataFrame:
    """Give every group all days 1..``days``, with ``fill`` where it had no row.

    A group has at most one row per day, so collecting it is bounded by ``days``.
    """
    pairs = F.map_from_entries(F.collect_list(F.struct("day_in_year", value)))
    return (
        df.groupBy(*keys)
        .agg(pairs.alias("_seen"))
        .select(*keys, "_seen", F.explode(F.sequence(F.lit(1), F.lit(days))).alias("day_in_year"))
        .withColumn(value, F.coalesce(F.try_element_at("_seen", "day_in_year"), fill))
        .drop("_seen")
    )


def rolling_users(daily: DataFrame, days: int = 14, name: str = "roll_14") -> DataFrame:
    """Sum of daily users over the last ``days`` days; null before a full window."""
    w = Window.partitionBy(*SITE, "nb_year").orderBy("day_in_year").rangeBetween(1 - days, 0)
    return daily.withColumn(name, F.when(F.col("day_in_year") >= days, F.sum("n_users").over(w)))


def peak_windows(presence: DataFrame, cfg: Config = Config(), dense: bool = False) -> DataFrame:
    """First window of ``cfg.window_days`` days with the most users, per site and cycle.

    A rolling sum can only reach a new high on a day with users, or on the first
    day that has a full window. Those days are enough, so the 366-day grid is
    built only with ``dense=True`` (same result).
    """
    n, keys = cfg.window_days, [*SITE, "nb_year"]
    daily = daily_users(presence, dense, cfg.cycle_days)
    if not dense:
        first_full = F.struct(F.lit(n).alias("day_in_year"), F.lit(0).cast("bigint").alias("n_users"))
        daily = (
            daily.groupBy(*keys)
            .agg(F.collect_list(F.struct("day_in_year", "n_users")).alias("_days"))
            .select(*keys, F.inline(F.concat("_days", F.array(first_full))))
        )
    w = Window.partitionBy(*keys).orderBy("day_in_year").rangeBetween(1 - n, 0)
    best = F.min(F.struct((-F.col("roll")).alias("neg"), F.col("day_in_year").alias("day")))
    end = F.col("peak_end_day")
    return (
        daily.withColumn("roll", F.sum("n_users").over(w))
        .filter(F.col("day_in_year") >= n)
        .groupBy(*keys)
        .agg(best.alias("_best"))
        .select(
            *keys,
            F.col("_best.day").alias("peak_end_day"),
            wrap_day(F.col("_best.day") - (n - 1), cfg.cycle_days).alias("peak_start_day"),
            (-F.col("_best.neg")).alias("peak_n_users_14d"),
        )
        .withColumn(
            "peak_window",
            F.concat_ws(
                " - ",
                cycle_day_label(F.col("peak_start_day"), cfg.anchor_month, cfg.anchor_day),
                cycle_day_label(end, cfg.anchor_month, cfg.anchor_day),
            ),
        )
    )


def tracked_by_cycle(presence: DataFrame, name: str = "n_total") -> DataFrame:
    """Animals with at least one site day, per cycle."""
    return (
        presence.select("nb_year", "local_identifier")
        .distinct()
        .groupBy("nb_year")
        .agg(F.count("*").alias(name))
    )


def site_use_by_year(presence: DataFrame) -> DataFrame:
    """Share of the cycle's animals that used each site."""
    used = (
        presence.select(*SITE, "nb_year", "local_identifier")
        .distinct()
        .groupBy(*SITE, "nb_year")
        .agg(F.count("*").alias("n_site"))
    )
    # one row per calendar year
    total = F.broadcast(tracked_by_cycle(presence))
    return used.join(total, "nb_year", "left").select(
        *SITE, "nb_year", "n_site", "n_total", F.try_divide("n_site", "n_total").alias("prop_site")
    )


def site_use_summary(use: DataFrame) -> DataFrame:
    """Mean and median share over the cycles in which a site was used.

    A site has one row per cycle, so the median sees a handful of values.
    """
    return use.groupBy(*SITE).agg(
        F.avg("prop_site").alias("prop_mean"),
        F.median("prop_site").alias("prop_median"),
        F.count("nb_year").alias("n_years"),
    )


def peak_mode(peaks: DataFrame) -> DataFrame:
    """Most frequent peak window per site; ties by mean peak, then by label."""
    best = F.min(
        F.struct(
            (-F.col("n")).alias("n"),
            (-F.col("mean_peak_n_users_14d")).alias("neg_mean"),
            "peak_window",
            "mean_peak_n_users_14d",
        )
    )
    return (
        peaks.groupBy(*SITE, "peak_window")
        .agg(F.avg("peak_n_users_14d").alias("mean_peak_n_users_14d"), F.count("*").alias("n"))
        .groupBy(*SITE)
        .agg(best.alias("_best"))
        .select(*SITE, "_best.peak_window", "_best.mean_peak_n_users_14d")
    )


def site_summary(use: DataFrame, peaks: DataFrame, sites: DataFrame) -> DataFrame:
    """One row per site: mean share, usual peak window and centre, busiest first."""
    keys = list(SITE)
    return (
        site_use_summary(use)
        .join(peak_mode(peaks), keys, "left")
        .join(sites.select(*SITE, "longitude", "latitude"), keys, "left")
        .select(
            *SITE,
            "prop_mean",
            "prop_median",
            "peak_window",
            "mean_peak_n_users_14d",
            "longitude",
            "latitude",
        )
        .orderBy(F.desc("prop_mean"), "site_id")
    )
