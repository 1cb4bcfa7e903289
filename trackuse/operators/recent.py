"""The latest cycles only; sites and names still come from all years."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackuse.config import Config
from trackuse.functions.season import with_cycle
from trackuse.operators.usage import peak_windows, presence_days, site_summary, site_use_by_year


def recent_cycles(fixes: DataFrame, n: int = 2, cfg: Config = Config()) -> DataFrame:
    """Fixes of the ``n`` latest cycles that occur among them."""
    dated = with_cycle(fixes, "date", cfg.anchor_month, cfg.anchor_day).drop("day_in_year")
    latest = dated.select("nb_year").distinct().orderBy(F.desc("nb_year")).limit(n)
    # n rows
    return dated.join(F.broadcast(latest), "nb_year", "left_semi")


def recent_site_summary(
    fixes: DataFrame, sites: DataFrame, n: int = 2, cfg: Config = Config()
) -> DataFrame:
    """The per-site summary computed within the latest cycles."""
    presence = presence_days(recent_cycles(fixes, n, cfg), cfg)
    return site_summary(site_use_by_year(presence), peak_windows(presence, cfg), sites)
