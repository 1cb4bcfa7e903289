"""Sites, projections, regions and routes."""

import datetime as dt
import math
import random
import statistics

import pytest
from conftest import rows
from pyspark.sql import functions as F

from trackuse.functions.project import inverse_mercator, mercator, ortho_xy, padded_extent, point_to_xy, snap_cells, with_cells
from trackuse.operators.regions import clip_box, points_in_region
from trackuse.operators.routes import first_daily_fix, representative_bird, routes, tag_site, with_tag_site
from trackuse.operators.sites import grouped_median, label_duplicates, nearest_reference, site_locations


@pytest.mark.parametrize("seed", range(3))
def test_median_equals_statistics(spark, seed):
    rnd = random.Random(seed)
    data = []
    for k in range(1, 8):
        pool = [round(rnd.uniform(-180, 180), rnd.choice([1, 3, 6])) for _ in range(rnd.randint(1, 12))]
        data += [(k, rnd.choice(pool), rnd.choice([rnd.uniform(-1, 1), None, float("nan"), 0.5])) for _ in range(rnd.randint(1, 60))]
    df = spark.createDataFrame(data, "k int, a double, b double")
    for r in grouped_median(df, "k", ["a", "b"], bin_width=(0.001, 1.0, 50.0)[seed]).collect():
        a = [x for k, x, _ in data if k == r["k"]]
        b = [x for k, _, x in data if k == r["k"] and x is not None and x == x]
        assert r["a"] == statistics.median(a)
        assert r["b"] == (statistics.median(b) if b else None)


def test_group_without_values_keeps_a_row(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0)], "k int, v double")
    assert sorted(rows(grouped_median(df, "k", ["v"]))) == [(1, None), (2, 3.0)]


def test_names_labels_and_fallback(spark):
    data = [(1, -16.5, 14.2), (2, -16.7, 14.0), (3, 0.8, 40.6)]
    fixes = spark.createDataFrame(data, "site_id int, location_long double, location_lat double")
    got = {r["site_id"]: (r["site_name"], r["site_label"]) for r in site_locations(fixes).collect()}
    assert got == {
        1: ("Saloum Delta", "Saloum Delta (site 1)"),
        2: ("Saloum Delta", "Saloum Delta (site 2)"),
        3: ("Ebro Delta", "Ebro Delta"),
    }
    none = {r["site_id"]: (r["site_label"], r["match_dist_km"]) for r in site_locations(fixes, []).collect()}
    assert none == {i: (f"site_{i}", None) for i in (1, 2, 3)}


def test_nearest_tie_takes_the_first_listed(spark):
    sites = spark.createDataFrame([(1, 0.0, 0.0)], "site_id int, longitude double, latitude double")
    row = nearest_reference(sites, [("east", 0.0, 1.0), ("west", 0.0, -1.0)]).first()
    assert row["site_name"] == "east"
    assert row["match_dist_km"] == pytest.approx(math.radians(1) * 6378.137)
    assert label_duplicates(nearest_reference(sites)).count() == 1


def test_mercator_and_back(spark):
    df = spark.createDataFrame([(0.0, 0.0), (180.0, 45.0), (-16.6, 14.1), (8.4, -53.2)], "lon double, lat double")
    mx, my = mercator("lon", "lat")
    lon, lat = inverse_mercator("mx", "my")
    for r in df.withColumns({"mx": mx, "my": my}).withColumns({"lon2": lon, "lat2": lat}).collect():
        assert (r["lon2"], r["lat2"]) == pytest.approx((r["lon"], r["lat"]), abs=1e-9)
        assert r["my"] == pytest.approx(6378137 * math.asinh(math.tan(math.radians(r["lat"]))), abs=1e-6)


def test_cells_round_half_to_even(spark):
    # one degree of longitude so that x is a multiple of half a cell
    half = math.degrees(125 / 6378137.0)
    df = spark.createDataFrame([(half * k, 0.0) for k in (1, 3, 5, -1)], "lon double, lat double")
    got = [round(r["mx"] / 250, 9) for r in with_cells(df, "lon", "lat").collect()]
    assert got == [0.5, 1.5, 2.5, -0.5]
    exact = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "v double")
    assert [r[0] for r in rows(exact.select(F.rint("v").cast("bigint")))] == [0, 2, 2, 0]
    assert snap_cells(with_cells(df, "lon", "lat")).agg(F.sum("n_pts")).first()[0] == 4


def test_ortho_centre_and_far_side(spark):
    df = spark.createDataFrame([(-10.0, 35.0), (170.0, -35.0), (-10.0, 36.0)], "lon double, lat double")
    x, y = ortho_xy("lon", "lat")
    centre, far, north = rows(df.select(x, y))
    assert centre == pytest.approx((0.0, 0.0), abs=1e-6)
    assert far == (None, None)
    # one degree of meridian arc near 35 N is about 110.9 km
    assert north[0] == pytest.approx(0, abs=1e-6) and north[1] == pytest.approx(110_940, abs=60)


def test_extent_and_wkt(spark):
    df = spark.createDataFrame([(0.0, 0.0), (10.0, 5.0)], "x double, y double")
    assert rows(padded_extent(df, "x", "y", 0.6, 0.4)) == [(-6.0, 16.0, -2.0, 7.0, 22 / 9)]
    wkt = spark.createDataFrame([("POINT (1.5 -2e1)", 1), ("point(3 4)", 2), ("POINT EMPTY", 3)], "g string, id int")
    assert rows(point_to_xy(wkt, "g")) == [(1.5, -20.0, 1), (3.0, 4.0, 2), (None, None, 3)]


OUTLINE = "region string, ring_id int, vertices array<struct<x:double,y:double>>"


def outlines(spark, data):
    return spark.createDataFrame([(r, i, [{"x": float(x), "y": float(y)} for x, y in c]) for r, i, c in data], OUTLINE)


def test_holes_overlaps_edges_and_bands(spark):
    polygons = outlines(
        spark,
        [
            ("ring", 1, [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]),
            ("ring", 2, [(4, 4), (6, 4), (6, 6), (4, 6)]),
            ("tri", 1, [(8, 8), (14, 8), (8, 14)]),
            ("other", 1, [(20, 20), (30, 20), (30, 30)]),
        ],
    )
    points = {
        "in": (1.0, 1.0), "hole": (5.0, 5.0), "both": (9.0, 9.0), "tri": (9.0, 11.0), "out": (13.5, 13.5),
        "west edge": (0.0, 5.0), "north edge": (5.0, 10.0), "corner": (10.0, 0.0), "hole edge": (4.0, 5.0),
        "level with corner": (2.0, 4.0), "not asked": (27.0, 22.0),
    }
    df = spark.createDataFrame([(n, *p) for n, p in points.items()], "name string, X double, Y double")
    for band in (500.0, 20_000.0, 5_000_000.0):
        got = [r["name"] for r in points_in_region(df, polygons, ["ring", "tri"], band_m=band).collect()]
        assert sorted(got) == ["both", "in", "level with corner", "tri"]


def test_shared_borders_are_inside(spark):
    polygons = outlines(
        spark,
        [
            ("west", 1, [(0, 0), (5, 0), (5, 5), (5, 10), (0, 10)]),
            ("east", 1, [(5, 0), (9, 0), (9, 5), (5, 5)]),
            ("north", 1, [(5, 5), (9, 5), (9, 10), (5, 10)]),
        ],
    )
    points = {
        "two": (5.0, 3.0), "three": (5.0, 5.0), "flat": (7.0, 5.0), "end": (5.0, 0.0), "top": (5.0, 10.0),
        "outer": (9.0, 5.0), "in": (1.0, 5.0), "out": (9.5, 5.0),
    }
    df = spark.createDataFrame([(n, *p) for n, p in points.items()], "name string, X double, Y double")
    found = lambda *names: sorted(r["name"] for r in points_in_region(df, polygons, names).collect())
    assert found("west", "east", "north") == ["flat", "in", "three", "two"]
    assert found("west", "east") == ["in", "two"] and found("east") == []


def test_clip_is_inclusive(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 2.0), (1.1, 0.0), (0.5, None)], "X double, Y double")
    assert rows(clip_box(df, (0.0, 1.0), (0.0, 2.0))) == [(0.0, 0.0), (1.0, 2.0)]


RULES = [
    ("my south holland study", "NL", "South Holland"), ("BTGTAGUS", None, "Tagus estuary"), ("x EXTREMADURA", "NL", "Extremadura"),
    (None, "Dümmer", "Dümmer"), ("none", "Unterelbe", "Unterelbe"), (None, "NL", "SW Friesland"), (None, None, None), ("none", "", None),
]


def test_tag_site_rules_in_order(spark):
    df = spark.createDataFrame(RULES, "study_name string, study_site string, want string")
    assert all(a == b for a, b in rows(df.select("want", tag_site())))


def test_routes(spark):
    t = dt.datetime
    data = [
        # a: first day without a tagging site, then NL; a site change later does not count
        ("a", 1.0, 1.0, t(2021, 6, 2, 5), None, None), ("a", 2.0, 2.0, t(2021, 6, 3, 9), "NL", None),
        ("a", 9.0, 9.0, t(2021, 6, 3, 10), "NL", None), ("a", 3.0, 3.0, t(2021, 6, 4), "Dümmer", None),
        # b: same tagging site, as many days: the identifier decides
        ("b", 5.0, 5.0, t(2021, 6, 2), "NL", None), ("b", 6.0, 6.0, t(2021, 6, 3), "NL", None), ("b", 7.0, 7.0, t(2021, 6, 4), "NL", None),
        # ends of the period, missing coordinates, no tagging site
        ("c", 1.0, 1.0, t(2021, 6, 1), "Dümmer", None), ("c", None, 1.0, t(2021, 7, 1), "Dümmer", None),
        ("c", 1.0, 1.0, t(2022, 6, 1), "Dümmer", None), ("d", 1.0, 1.0, t(2021, 7, 1), None, "x"),
        (None, 8.0, 8.0, t(2021, 8, 1), "Unterelbe", None), (None, 8.5, 8.5, t(2021, 7, 1), "Unterelbe", None),
    ]
    df = spark.createDataFrame(
        data, "individual_local_identifier string, X double, Y double, timestamp timestamp_ntz, study_site string, study_name string"
    )
    daily = first_daily_fix(df, "2021-06-01", "2022-06-01")
    assert daily.count() == 9
    assert sorted(rows(representative_bird(with_tag_site(daily))), key=repr) == [("SW Friesland", "a", 3), ("Unterelbe", None, 2)]
    got = {r[0]: (r[1], [(p["x"], p["y"]) for p in r[2]]) for r in rows(routes(df))}
    assert got == {"SW Friesland": ("a", [(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)]), "Unterelbe": (None, [(8.5, 8.5), (8.0, 8.0)])}
