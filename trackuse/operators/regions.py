"""Fixes inside rectangles and inside country outlines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackuse.functions.project import mercator
from trackuse.operators import outline_cells as cells

FARTHEST_M = 1e9


def clip_box(
    df: DataFrame, xlim: tuple[float, float], ylim: tuple[float, float], x: str = "X", y: str = "Y"
) -> DataFrame:
    return df.filter(F.col(x).between(*xlim) & F.col(y).between(*ylim))


def _edges(polygons: DataFrame, regions: Sequence[str]) -> DataFrame:
    """The edges of the named outlines in Mercator metres, rings closed: ``outline, x1, y1, x2, y2``."""
    corners = F.transform(
        "vertices",
        lambda p: F.struct(*[c.alias(n) for c, n in zip(mercator(p["x"], p["y"]), ("x", "y"))]),
    )
    rings = polygons.filter(F.col("region").isin(*regions)).select(F.col("region").alias("outline"), corners.alias("corners"))
    # one corner a row, and the next one from the ring itself
    each = rings.select("outline", "corners", F.posexplode("corners").alias("i", "a"))
    following = F.get("corners", F.expr("(i + 1) % size(corners)"))
    ends = each.select("outline", "a", following.alias("b")).selectExpr("outline", "a.x AS x1", "a.y AS y1", "b.x AS x2", "b.y AS y2")
    finite = " AND ".join(f"abs({n}) < {FARTHEST_M}D" for n in cells.ENDS)
    return ends.filter(finite).filter("x1 <> x2 OR y1 <> y2")


# Whether a point of a border cell is inside: of one outline, touching none of its edges, or of
# all together. All together, edges that two outlines share are no border.
_CROSSES = f"{cells.crosses_west('e.', '_x', '_y', '_east')} <> {cells.crosses_north('e.', '_east', '_south', '_y')}"
_ON_EDGE = cells.touches("e.", "_x", "_y")
_TESTS = f"""transform(outlines, o -> struct(
    aggregate(o.edges, o.inside, (odd, e) -> odd <> ({_CROSSES})) AS odd,
    exists(o.edges, e -> {_ON_EDGE}) AS touched,
    exists(o.edges, e -> NOT e.shared AND {_ON_EDGE}) AS at_rim))"""
_INSIDE = """exists(_tests, t -> t.odd AND NOT t.touched)
    OR aggregate(_tests, false, (odd, t) -> odd <> t.odd) AND NOT exists(_tests, t -> t.at_rim)"""


def _inside_crowded(places: DataFrame, rest: DataFrame, side: float) -> DataFrame:
    """``_x, _y`` of the places inside, in cells whose edges are too many for one row: edges are summed one by one."""
    east, south = cells.line("cx + 1", cells.number(side), 0), cells.line("cy", cells.number(side), 1)
    crosses = F.expr(f"{cells.crosses_west('', '_x', '_y', east)} <> {cells.crosses_north('', east, south, '_y')}")
    touched = F.expr(cells.touches("", "_x", "_y"))
    tests = (
        places.join(rest, cells.CELL)
        .groupBy("_x", "_y", "outline", "inside")
        .agg(
            F.sum(crosses.cast("int")).alias("n"),
            F.max(touched).alias("touched"),
            F.max(touched & ~F.col("shared")).alias("at_rim"),
        )
        .withColumn("odd", F.col("inside") != (F.col("n") % 2 == 1))
    )
    found = tests.groupBy("_x", "_y").agg(
        F.max(F.col("odd") & ~F.col("touched")).alias("one"),
        (F.sum(F.col("odd").cast("int")) % 2 == 1).alias("together"),
        F.max("at_rim").alias("at_rim"),
    )
    return found.where("one OR (together AND NOT at_rim)").select("_x", "_y")


def points_in_region(
    points: DataFrame,
    polygons: DataFrame,
    regions: Sequence[str],
    lon: str = "X",
    lat: str = "Y",
    band_m: float = 20_000.0,
) -> DataFrame:
    """Points strictly inside the named outlines, taken together.

    ``polygons``: region, ring_id, vertices array<struct<x,y>> in degrees; holes
    are further rings of the same region. The test runs in Mercator metres, as
    outlines are straight there. A fix on a border that two of the outlines share
    is inside, also where one of them has further corners on it (within a centimetre).
    Points without coordinates, and outlines without corners, give nothing.

    Outlines become cells (``outline_cells``) whose sides are ``band_m`` times or divided by powers of
    four. A point in a cell wholly inside is settled by the join alone; in a border cell
    it meets that cell's edges, 64 at most. The cells are staged, so their file size
    decides whether Spark broadcasts them (points are then not shuffled) or joins by
    shuffle. Every level of cells that outlines need, usually one to three, is one look-up.
    """
    found, sides, rest = cells.cover(_edges(polygons, regions), band_m)
    mx, my = mercator(lon, lat)
    placed = points.select(F.struct("*").alias("_point"), mx.alias("_x"), my.alias("_y"))
    placed = placed.where(f"abs(_x) < {FARTHEST_M}D AND abs(_y) < {FARTHEST_M}D")
    keys = [
        f"struct({level} AS level, {cells.index_of('_x', cells.number(s), 0)} AS cx, {cells.index_of('_y', cells.number(s), 1)} AS cy)"
        for level, s in enumerate(sides)
    ]
    looked = placed.selectExpr("*", f"inline(array({', '.join(keys)}))")
    met = looked.join(found, cells.CELL)
    side = f"element_at(array({', '.join(map(cells.number, sides))}), level + 1)"
    met = met.selectExpr("*", f"{cells.line('cx + 1', side, 0)} AS _east", f"{cells.line('cy', side, 1)} AS _south")
    met = met.selectExpr("*", f"IF(outlines IS NULL, NULL, {_TESTS}) AS _tests")
    kept = met.where(f"outlines IS NULL OR {_INSIDE}").select("_point.*")
    if rest is None:
        return kept
    at_last = looked.where(F.col("level") == len(sides) - 1)
    crowded = at_last.join(rest.select(*cells.CELL).distinct(), cells.CELL, "left_semi")
    settled = _inside_crowded(crowded.select("_x", "_y", *cells.CELL).distinct(), rest, sides[-1])
    return kept.unionByName(crowded.join(settled, ["_x", "_y"], "left_semi").select("_point.*"))
