"""Outlines as cells: bounded rows, noding, and equality with a plain test of every edge."""

import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from trackuse.operators import outline_cells, regions
from trackuse.operators.outline_cells import MAX_EDGES, cover
from trackuse.operators.regions import points_in_region

OUTLINE = "region string, ring_id int, vertices array<struct<x:double,y:double>>"
R = 6_378_137.0


def metres(lon, lat):
    return math.radians(lon) * R, math.log(math.tan(math.radians(lat) / 2 + math.pi / 4)) * R


def degrees(x, y):
    return math.degrees(x / R), math.degrees(2 * math.atan(math.exp(y / R)) - math.pi / 2)


def outlines(spark, data):
    return spark.createDataFrame([(r, 1, [{"x": float(x), "y": float(y)} for x, y in c]) for r, c in data], OUTLINE)


def odd(corners, lon, lat):
    """Crossing parity over all edges, in Mercator metres."""
    x, y = metres(lon, lat)
    inside = False
    places = [metres(*c) for c in corners]
    for (x1, y1), (x2, y2) in zip(places, places[1:] + places[:1]):
        if (y1 > y) != (y2 > y) and x < x1 + (x2 - x1) * (y - y1) / (y2 - y1):
            inside = not inside
    return inside


def star(rng, lon, lat, corners, size):
    """An outline with many turns around a place; rings may cross themselves."""
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(corners))
    return [(lon + math.cos(t) * size * (r := rng.uniform(0.2, 1)), lat + math.sin(t) * size * r) for t in turns]


@pytest.mark.parametrize(("most", "depth", "unit"), [(64, 12, 20_000.0), (3, 12, 20_000.0), (3, 1, 700_000.0), (2, 0, 3e6)])
def test_equal_to_a_test_of_every_edge(spark, monkeypatch, most, depth, unit):
    monkeypatch.setattr(outline_cells, "MAX_EDGES", most)
    monkeypatch.setattr(outline_cells, "DEPTH", depth)
    rng = random.Random(most * 100 + depth)
    data = [("a", star(rng, 3, 41, 40, 4)), ("b", star(rng, 6, 43, 25, 3)), ("c", [(-5, 36), (9, 36.5), (9, 47), (-4, 46)])]
    data += [("a", star(rng, 3.5, 41.2, 12, 1.5))]  # a second ring: a hole where it overlaps
    points = [(i, rng.uniform(-7, 11), rng.uniform(34, 49)) for i in range(1_500)]
    # level with corners, and on a line with them
    points += [(10_000 + i, rng.uniform(-7, 11), c[1]) for i, c in enumerate(data[0][1])]
    points += [(20_000 + i, c[0], rng.uniform(34, 49)) for i, c in enumerate(data[1][1])]
    df = spark.createDataFrame(points, "id int, X double, Y double")
    for names in (["a", "b"], ["a", "b", "c"]):
        found = {r["id"] for r in points_in_region(df, outlines(spark, data), names, band_m=unit).collect()}
        expected = set()
        for i, lon, lat in points:
            by = {n: sum(odd(c, lon, lat) for r, c in data if r == n) % 2 for n in names}
            if any(by.values()):
                expected.add(i)
        assert found == expected and 0 < len(found) < len(points)


def test_rows_stay_small_for_very_many_corners(spark):
    n = 100_000
    ring = [(2 + 3 * math.cos(2 * math.pi * k / n), 45 + 2 * math.sin(2 * math.pi * k / n)) for k in range(n)]
    polygons = spark.createDataFrame([("round", 1, [{"x": x, "y": y} for x, y in ring])], OUTLINE)
    found, sides, rest = cover(regions._edges(polygons, ["round"]), 20_000.0)
    size = F.aggregate("outlines", F.lit(0), lambda n, o: n + F.size(o["edges"]))
    assert rest is None and len(sides) > 1
    assert found.agg(F.max(size)).first()[0] <= MAX_EDGES
    rng = random.Random(1)
    points = [(i, 2 + rng.uniform(-3.2, 3.2), 45 + rng.uniform(-2.2, 2.2)) for i in range(3_000)]
    df = spark.createDataFrame(points, "id int, X double, Y double")
    got = {r["id"] for r in points_in_region(df, polygons, ["round"]).collect()}
    assert got == {i for i, x, y in points if ((x - 2) / 3) ** 2 + ((y - 45) / 2) ** 2 < 1}


def test_border_with_other_corners(spark):
    # level, upright and sloped borders; the eastern neighbour has further corners on them
    a, b = metres(2, 40), metres(5, 44)
    between = [degrees(a[0] + (b[0] - a[0]) * s, a[1] + (b[1] - a[1]) * s) for s in (0.25, 0.5, 0.8)]
    west = [(0, 40), (2, 40), (5, 44), (5, 46), (0, 46)]
    east = [(2, 40), (8, 40), (8, 46), (5, 46), (5, 45.3), (5, 44), *reversed(between)]
    south = [(0, 38), (8, 38), (8, 40), (7, 40), (2, 40), (1, 40), (0, 40)]
    polygons = outlines(spark, [("west", west), ("east", east), ("south", south)])
    on_slope = [degrees(a[0] + (b[0] - a[0]) * s, a[1] + (b[1] - a[1]) * s) for s in (0.1, 0.25, 0.4, 0.5, 0.8, 0.9)]
    points = {f"slope {k}": p for k, p in enumerate(on_slope)}
    points |= {"upright": (5.0, 44.7), "corner": (5.0, 45.3), "level": (1.5, 40.0), "level 2": (6.5, 40.0), "end": (5.0, 46.0)}
    points |= {"three": (2.0, 40.0), "outer": (8.0, 43.0), "far": (9.0, 43.0), "in": (1.0, 44.0)}
    df = spark.createDataFrame([(n, float(x), float(y)) for n, (x, y) in points.items()], "name string, X double, Y double")
    found = lambda *names: {r["name"] for r in points_in_region(df, polygons, names).collect()}
    assert found("west", "east", "south") == set(points) - {"end", "outer", "far"}
    assert found("west", "east") == set(points) - {"end", "outer", "far", "level", "level 2", "three"}


def test_more_edges_in_one_corner_than_a_row_may_have(spark, monkeypatch):
    monkeypatch.setattr(outline_cells, "MAX_EDGES", 6)
    monkeypatch.setattr(outline_cells, "DEPTH", 2)
    petals = [(f"p{k}", [(3, 42), (3 + 2 * math.cos(k), 42 + 2 * math.sin(k)), (3 + 2 * math.cos(k + 0.4), 42 + 2 * math.sin(k + 0.4))]) for k in range(7)]
    polygons = outlines(spark, petals)
    names = [n for n, _ in petals]
    assert cover(regions._edges(polygons, names), 20_000.0)[2] is not None
    rng = random.Random(5)
    points = [(i, 3 + rng.gauss(0, 10.0 ** -rng.randrange(4)), 42 + rng.gauss(0, 10.0 ** -rng.randrange(4))) for i in range(800)]
    points += points[:50]
    df = spark.createDataFrame(points, "id int, X double, Y double")
    got = sorted(r["id"] for r in points_in_region(df, polygons, names).collect())
    assert got == sorted(i for i, x, y in points if any(odd(c, x, y) for _, c in petals))


def test_odd_rows(spark):
    polygons = outlines(spark, [("a", [(0, 40), (4, 40), (4, 44), (0, 44)]), ("none", []), ("line", [(0, 0), (1, 1)])])
    nothing = spark.createDataFrame([("a", 1, None), (None, 1, [(0.0, 0.0)]), ("a", 2, [(None, 1.0), (2.0, None)])], OUTLINE)
    points = [("in", 1.0, 41.0), ("in", 1.0, 41.0), (None, 1.0, 41.0), ("no x", None, 41.0), ("nan", float("nan"), 41.0), ("pole", 1.0, 90.0)]
    df = spark.createDataFrame(points, "level string, X double, Y double").withColumn("outlines", F.lit("own"))
    got = points_in_region(df, polygons.unionByName(nothing), ["a", "none", "line"])
    assert got.columns == df.columns and sorted(rows(got), key=str) == sorted([(n, 1.0, 41.0, "own") for n in ("in", "in", None)], key=str)
    assert points_in_region(df, polygons, ["none"]).count() == 0 and points_in_region(df.limit(0), polygons, ["a"]).count() == 0
