"""Stationary nonbreeding fixes, thinned per day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackuse.config import Config
from trackuse.functions.season import as_utc
from trackuse.operators.ordering import first_n_per_group, no_nan, same_key
from trackuse.sources.staging import stage

__all__ = [
    "clean_locations",
    "first_n_per_group",
    "group_range_filter",
    "nonbreeding",
    "require_values",
    "stationary",
    "time_range",
]


def stationary(
    df: DataFrame, exclude_sites: Sequence[str] = ("PL",), speed_col: str = "ground_speed"
) -> DataFrame:
    """Speed unknown or exactly 0, outside the excluded sites.

    A null site is dropped, an empty one kept.
    """
    speed = no_nan(df, speed_col)
    if exclude_sites:
        df = df.filter(~F.col("study_site").isin(*exclude_sites))
    return df.filter(speed.isNull() | (speed == 0))


def time_range(df: DataFrame, ts: str, start: str, end: str, closed: str = "left") -> DataFrame:
    """``closed='left'``: start <= t < end. ``'neither'``: both ends strict."""
    if closed not in ("left", "neither"):
        raise ValueError("closed must be 'left' or 'neither'")
    lo, hi = (F.lit(v).cast("timestamp_ntz") for v in (start, end))
    lower = F.col(ts) >= lo if closed == "left" else F.col(ts) > lo
    return df.filter(lower & (F.col(ts) < hi))


def group_range_filter(
    df: DataFrame, key: str, value: str, min_range: float = 5.0
) -> DataFrame:
    """Rows of groups whose value spans at least ``min_range``.

    Min and max are combined before the shuffle, so a huge group costs one row
    per task. The surviving keys are staged: Spark broadcasts them if the file
    is small and joins by shuffle, with skew splitting, if it is not.
    """
    v = no_nan(df, value)
    wide = (
        df.groupBy(F.col(key).alias("_wide_key"))
        .agg((F.max(v) - F.min(v)).alias("_range"))
        .filter(F.col("_range") >= min_range)
        .select("_wide_key")
    )
    wide = stage(wide, "wide-ranging")
    return df.join(wide, same_key(df, wide, [(key, "_wide_key")]), "left_semi")


def nonbreeding(df: DataFrame, lat: str = "location_lat", max_lat: float = 42.0) -> DataFrame:
    return df.filter(F.col(lat) < max_lat)


def require_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows where every listed column has a value."""
    for c in cols:
        df = df.filter(no_nan(df, c).isNotNull())
    return df


def clean_locations(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Stationary fixes of migrating animals south of the breeding grounds.

    The order matters: ranges are measured over all latitudes, and a fix without
    coordinates may use up a daily slot before it is removed.
    """
    named = df.withColumn("timestamp", as_utc(df, "timestamp")).withColumns(
        {
            "date": F.to_date("timestamp"),
            "location_lat": F.col("Y"),
            "location_long": F.col("X"),
            "local_identifier": F.col("individual_local_identifier"),
        }
    )
    still = time_range(stationary(named, cfg.exclude_sites), "timestamp", cfg.start, cfg.end)
    migrants = group_range_filter(still, "local_identifier", "location_lat", cfg.min_lat_range)
    south = nonbreeding(migrants, "location_lat", cfg.max_lat)
    thinned = first_n_per_group(south, ["local_identifier", "date"], ["timestamp"], cfg.fixes_per_day)
    return require_values(thinned, ["location_lat", "location_long"])
