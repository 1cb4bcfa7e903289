"""The whole analysis: from locations to site tables, full period and recent."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from trackuse.config import Config
from trackuse.functions.project import snap_cells, with_cells
from trackuse.operators.clean import clean_locations
from trackuse.operators.density import assign_sites, dbscan
from trackuse.operators.recent import recent_cycles
from trackuse.operators.sites import name_fixes, site_locations
from trackuse.operators.usage import peak_windows, presence_days, site_summary, site_use_by_year
from trackuse.sources.staging import stage
from trackuse.sources.tables import read_locations, require_columns, write_outputs


@dataclass(frozen=True)
class Sites:
    clean: DataFrame
    fixes: DataFrame
    locations: DataFrame


def find_sites(locations: DataFrame, cfg: Config = Config()) -> Sites:
    """Clean fixes, cluster them, and name the sites.

    Tables read more than once afterwards are staged, so cleaning and clustering
    run once for the full and the recent tables.
    """
    require_columns(locations)
    clean = stage(clean_locations(locations, cfg), "clean-locations")
    celled = with_cells(clean, "location_long", "location_lat", cfg.grid_m)
    cells = snap_cells(celled).select("gx", "gy")
    labelled = stage(dbscan(cells, cfg.eps_cells, cfg.min_pts), "labelled-cells")
    fixes = stage(assign_sites(celled, labelled), "site-fixes")
    sites = stage(site_locations(fixes, cfg.reference_points), "site-locations")
    return Sites(clean, name_fixes(fixes, sites), sites)


def site_tables(fixes: DataFrame, sites: DataFrame, cfg: Config = Config()) -> dict[str, DataFrame]:
    """Derived tables for one set of site fixes."""
    presence = stage(presence_days(fixes, cfg), "presence-days")
    peaks = stage(peak_windows(presence, cfg), "peak-windows")
    use = stage(site_use_by_year(presence), "site-use")
    return {
        "site_location_fixes": fixes,
        "site_presence_days": presence,
        "site_peak_windows_by_year": peaks,
        "site_use_by_year": use,
        "site_summary_points": site_summary(use, peaks, sites),
    }


def full_tables(found: Sites, cfg: Config = Config()) -> dict[str, DataFrame]:
    return site_tables(found.fixes, found.locations, cfg)


def recent_tables(found: Sites, cfg: Config = Config()) -> dict[str, DataFrame]:
    """The same for the latest cycles, without the peak table."""
    tables = site_tables(recent_cycles(found.fixes, cfg.recent, cfg), found.locations, cfg)
    del tables["site_peak_windows_by_year"]
    return tables


def run_site_use(
    spark: SparkSession, input_path: str, output_dir: str, cfg: Config = Config(), fmt: str = "csv"
) -> None:
    """Read locations, write five full tables and four recent ones."""
    found = find_sites(read_locations(spark, input_path, fmt), cfg)
    by_cycle = {"site_presence_days": "nb_year"}
    write_outputs(full_tables(found, cfg), output_dir, by_cycle)
    write_outputs(recent_tables(found, cfg), f"{output_dir}/recent", by_cycle)
