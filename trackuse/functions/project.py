"""Map projections and the lattice, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_378_137.0
_FLATTENING = 1 / 298.257223563
_E2 = _FLATTENING * (2 - _FLATTENING)


def mercator(lon: Column | str, lat: Column | str) -> tuple[Column, Column]:
    """EPSG:4326 degrees to EPSG:3857 metres."""
    mx = F.radians(lon) * EARTH_RADIUS_M
    my = F.ln(F.tan(F.radians(lat) / 2 + math.pi / 4)) * EARTH_RADIUS_M
    return mx, my


def inverse_mercator(mx: Column | str, my: Column | str) -> tuple[Column, Column]:
    """EPSG:3857 metres back to EPSG:4326 degrees."""
    mx = F.col(mx) if isinstance(mx, str) else mx
    my = F.col(my) if isinstance(my, str) else my
    lat = F.atan(F.exp(my / EARTH_RADIUS_M)) * 2 - math.pi / 2
    return F.degrees(mx / EARTH_RADIUS_M), F.degrees(lat)


def ortho_xy(
    lon: Column | str, lat: Column | str, lat0: float = 35.0, lon0: float = -10.0
) -> tuple[Column, Column]:
    """Orthographic metres on the WGS84 ellipsoid (EPSG method 9840).

    Points on the far side of the globe give null.
    """
    p0 = math.radians(lat0)
    s0, c0 = math.sin(p0), math.cos(p0)
    nu0 = EARTH_RADIUS_M / math.sqrt(1 - _E2 * s0 * s0)
    phi, lam = F.radians(lat), F.radians(lon) - math.radians(lon0)
    s, c = F.sin(phi), F.cos(phi)
    nu = F.lit(EARTH_RADIUS_M) / F.sqrt(F.lit(1.0) - s * s * _E2)
    x = nu * c * F.sin(lam)
    y = nu * (s * c0 - c * F.cos(lam) * s0) + (F.lit(nu0 * s0) - nu * s) * (_E2 * c0)
    seen = s * s0 + c * F.cos(lam) * c0 >= -1e-10
    return F.when(seen, x), F.when(seen, y)


def point_to_xy(df: DataFrame, wkt_col: str, x: str = "X", y: str = "Y") -> DataFrame:
    """Replace ``POINT (x y)`` text by two double columns."""
    number = r"([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    pattern = rf"(?i)^\s*POINT\s*\(\s*{number}\s+{number}"
    return df.select(
        *[F.regexp_extract(wkt_col, pattern, i).try_cast("double").alias(n) for i, n in ((1, x), (2, y))],
        *[c for c in df.columns if c not in (wkt_col, x, y)],
    )


def with_cells(df: DataFrame, lon: str, lat: str, grid: float = 250.0) -> DataFrame:
    """Add Mercator ``mx``/``my`` and integer lattice cells ``gx``/``gy``.

    Cells round half to even, so ``rint`` and not ``round``.
    """
    mx, my = mercator(lon, lat)
    return (
        df.withColumns({"mx": mx, "my": my})
        .withColumn("gx", F.rint(F.col("mx") / grid).cast("bigint"))
        .withColumn("gy", F.rint(F.col("my") / grid).cast("bigint"))
    )


def snap_cells(df: DataFrame) -> DataFrame:
    """Occupied cells with their number of fixes."""
    return df.groupBy("gx", "gy").agg(F.count("*").alias("n_pts"))


def padded_extent(
    df: DataFrame, x: str, y: str, pad_x: float = 0.4, pad_y: float = 0.4
) -> DataFrame:
    """Bounding box widened by a share of each side, with its aspect ratio."""
    box = df.agg(*[f(c).alias(f"{n}{a}") for n, f in (("min", F.min), ("max", F.max))
                   for c, a in ((x, "x"), (y, "y"))])
    dx, dy = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    return box.select(
        (F.col("minx") - dx * pad_x).alias("xmin"),
        (F.col("maxx") + dx * pad_x).alias("xmax"),
        (F.col("miny") - dy * pad_y).alias("ymin"),
        (F.col("maxy") + dy * pad_y).alias("ymax"),
    ).withColumn("aspect", F.try_divide(F.expr("xmax - xmin"), F.expr("ymax - ymin")))
