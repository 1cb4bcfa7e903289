"""The tables behind the figures; drawing itself is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackuse.fixed_values import REGION_BOXES, REGIONS
from trackuse.functions.project import ortho_xy, padded_extent
from trackuse.operators.profile import annual_use_order, axis_breaks, map_labels
from trackuse.operators.regions import clip_box, points_in_region
from trackuse.operators.routes import routes
from trackuse.sources.tables import tag_sites


def _on_globe(df: DataFrame, lon: str, lat: str) -> DataFrame:
    x, y = ortho_xy(lon, lat)
    return df.withColumns({"x": x, "y": y})


def tag_site_map(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Tagging sites on the orthographic map, and the map extent."""
    points = _on_globe(tag_sites(spark), "lon", "lat")
    return points, padded_extent(points, "x", "y", 0.4, 0.4)


def route_map(
    locations: DataFrame, start: str = "2021-06-01", end: str = "2022-06-01"
) -> tuple[DataFrame, DataFrame]:
    """Route points of one bird per tagging site in order, and the map extent."""
    lines = routes(locations, start, end)
    points = lines.select(
        "tag_site",
        "individual_local_identifier",
        F.posexplode("route").alias("pos", "point"),
    ).select(
        "tag_site",
        "individual_local_identifier",
        "pos",
        F.col("point.ts").alias("timestamp"),
        F.col("point.x").alias("lon"),
        F.col("point.y").alias("lat"),
    )
    points = _on_globe(points, "lon", "lat")
    return points, padded_extent(points, "x", "y", 0.4, 0.4)


def flyway_map(summary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labelled sites on the orthographic map, and the map extent."""
    points = _on_globe(map_labels(summary), "longitude", "latitude")
    return points, padded_extent(points, "x", "y", 0.6, 0.4)


def annual_panels(use: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Yearly shares in panel order, and the year axis."""
    return annual_use_order(use), axis_breaks(use, "nb_year", 2)


def regional_map(fixes: DataFrame, outlines: DataFrame, view: str) -> DataFrame:
    """Site fixes inside the countries of a view and inside its lon/lat box.

    ``outlines`` holds country outlines as described in ``points_in_region``.
    """
    inside = points_in_region(fixes, outlines, REGIONS[view], "location_long", "location_lat")
    return clip_box(inside, *REGION_BOXES[view], "location_long", "location_lat")
