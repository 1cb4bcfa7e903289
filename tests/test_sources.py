import time

import pytest
from conftest import rows

from trackuse.config import Config
from trackuse.fixed_values import REFERENCE_POINTS
from trackuse.plans.figures import annual_panels, flyway_map, regional_map, route_map, tag_site_map
from trackuse.plans.site_use import run_site_use
from trackuse.sources.staging import discard, shared_dir, stage
from trackuse.sources.tables import (
    LOCATION_SCHEMA,
    read_locations,
    read_output,
    read_studies,
    reference_points,
    require_columns,
    write_locations,
)

LOCATIONS = [
    ("007", 1.5, 40.25, "2021-06-01 10:00:00", "NL", "s", 0.0, "2020-01-01"),
    ("b", -3.0, 0.1 + 0.2, "2021-06-01", "", 'quo"ted, text', None, None),
    (None, None, None, None, None, None, None, None),
]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_locations_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame(LOCATIONS, LOCATION_SCHEMA)
    write_locations(df, f"{tmp_path}/out", fmt)
    back = read_locations(spark, f"{tmp_path}/out", fmt)
    assert back.schema == df.schema
    assert sorted(rows(back), key=repr) == sorted(LOCATIONS, key=repr)


def test_csv_as_exported(spark, tmp_path):
    header = '"' + '","'.join(LOCATION_SCHEMA.names) + '","taxon_detail"'
    lines = ['"007",1.5,40,"2021-06-01","","s",NA,NA,"x"', 'NA,NA,NA,NA,NA,NA,NA,NA,NA', '"9",2,bad,"2021-06-01","PL","s",0,NA,NA']
    (tmp_path / "in.csv").write_text("\n".join([header, *lines]) + "\n")
    got = rows(read_locations(spark, f"{tmp_path}/in.csv"))
    assert got[0] == ("007", 1.5, 40.0, "2021-06-01", "", "s", None, None, "x")
    assert got[1] == (None,) * 9
    assert got[2][2] is None and got[2][6] == 0.0


def test_missing_columns_are_named(spark, tmp_path):
    df = spark.createDataFrame(LOCATIONS, LOCATION_SCHEMA).drop("X", "ground_speed")
    with pytest.raises(ValueError, match="X, ground_speed"):
        require_columns(df)


def test_studies_with_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("individual_local_identifier,X,Y\n01,1,2\n")
    (tmp_path / "b.csv").write_text("Y,tag,X,individual_local_identifier\n4,t,3,02\n")
    out = read_studies(spark, {"A": f"{tmp_path}/a.csv", "B": f"{tmp_path}/b.csv"})
    got = sorted(rows(out.select("study_name", "individual_local_identifier", "X", "Y", "tag")))
    assert got == [("A", "01", 1.0, 2.0, None), ("B", "02", 3.0, 4.0, "t")]


def test_stage_uses_the_session_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = stage(spark.range(5), "numbers")
    assert shared_dir(spark) in df.inputFiles()[0]
    assert sorted(rows(df)) == [(i,) for i in range(5)]


def test_reference_points_are_distinct(spark):
    assert reference_points(spark, [*REFERENCE_POINTS, REFERENCE_POINTS[0]]).count() == 12


def test_whole_analysis_from_csv_to_tables_and_figures(spark, tmp_path):
    """Two birds over two cycles, one place in Spain and a lone stray."""
    data = []
    for year in (2019, 2020, 2021):
        for bird in ("a", "b"):
            for day in range(1, 21):
                step = (day * 7 + year) % 12
                data.append((bird, -5.93 + step * 0.01, 39.1 + step * 0.012, f"{year}-08-{day:02d} 05:00:00", "NL", "Extremadura x", 0.0, "2019-01-01"))
            data.append((bird, 5.5, 52.5, f"{year}-05-02 05:00:00", "NL", "Extremadura x", None, "2019-01-01"))
    data.append(("b", 10.0, 20.0, "2020-01-01", "NL", "Extremadura x", 0.0, "2019-01-01"))
    df = spark.createDataFrame(data, LOCATION_SCHEMA)
    write_locations(df, f"{tmp_path}/in", "csv")
    cfg = Config(grid_m=1000.0, eps_m=6000.0, min_pts=4)
    run_site_use(spark, f"{tmp_path}/in", f"{tmp_path}/out", cfg)
    full = {p.name for p in (tmp_path / "out").iterdir()} - {"recent"}
    assert full == {
        "site_location_fixes", "site_presence_days", "site_peak_windows_by_year", "site_use_by_year", "site_summary_points",
    }
    assert {p.name for p in (tmp_path / "out/recent").iterdir()} == full - {"site_peak_windows_by_year"}
    summary = read_output(spark, f"{tmp_path}/out", "site_summary_points")
    (row,) = summary.collect()
    assert (row["site_label"], row["prop_mean"], row["peak_window"]) == ("Extremadura", 1.0, "Aug 01 - Aug 14")
    assert row["mean_peak_n_users_14d"] == 28.0
    assert read_output(spark, f"{tmp_path}/out", "site_presence_days").count() == 120
    recent = read_output(spark, f"{tmp_path}/out/recent", "site_presence_days")
    assert {r["nb_year"] for r in recent.collect()} == {2020, 2021}

    points, box = flyway_map(summary)
    assert points.first()["label"] == "Extremadura: 100%" and box.count() == 1
    panels, ticks = annual_panels(read_output(spark, f"{tmp_path}/out", "site_use_by_year"))
    assert [r["axis_break"] for r in ticks.orderBy("axis_break").collect()] == [2019, 2021]
    assert {r["site_order"] for r in panels.collect()} == {1}
    spain = [("Spain", 1, [{"x": x, "y": y} for x, y in [(-7.0, 36.0), (0.0, 36.0), (0.0, 43.0), (-7.0, 43.0)]])]
    outlines = spark.createDataFrame(spain, "region string, ring_id int, vertices array<struct<x:double,y:double>>")
    fixes = read_output(spark, f"{tmp_path}/out", "site_location_fixes")
    assert regional_map(fixes, outlines, "iberia").count() == fixes.count() == 120
    line, _ = route_map(df, "2020-06-01", "2021-06-01")
    assert {r["individual_local_identifier"] for r in line.collect()} == {"a"} or line.count() == 21
    sites, extent = tag_site_map(spark)
    assert sites.count() == 6 and extent.first()["aspect"] > 0


def test_files_of_one_folder_with_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("individual_local_identifier,X,Y\n01,1,2\n")
    (tmp_path / "b.csv").write_text('Y,X,"individual_local_identifier"\n4,3,02\n5,x,03\n')
    (tmp_path / "empty.csv").write_text("")
    got = sorted(rows(read_studies(spark, {"A": str(tmp_path)}).select("study_name", "individual_local_identifier", "X", "Y")))
    assert got == [("A", "01", 1.0, 2.0), ("A", "02", 3.0, 4.0), ("A", "03", None, 5.0)]


def test_line_breaks_in_texts_survive(spark, tmp_path):
    data = [(*LOCATIONS[1][:4], 'two\nlines, "quoted"\r\nthree', *LOCATIONS[1][5:]), LOCATIONS[0]]
    write_locations(spark.createDataFrame(data, LOCATION_SCHEMA), f"{tmp_path}/out", "csv")
    back = rows(read_locations(spark, f"{tmp_path}/out", multi_line=True))
    assert sorted(back, key=repr) == sorted(data, key=repr)


def test_no_header_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        read_locations(spark, f"{tmp_path}/a.csv")


def test_staged_tables_can_be_deleted(spark):
    import os

    one, two = stage(spark.range(3), "gone"), stage(spark.range(3), "kept")
    discard(one)
    assert not os.path.exists(one.staged_path) and two.count() == 3


def test_the_shuffle_behind_a_staged_table_goes_at_once(spark):
    shuffles = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    stage(spark.range(10), "before", free_shuffles=True)
    time.sleep(2)
    before = shuffles.size()
    stage(spark.range(1000).repartition(3, "id"), "shuffled", free_shuffles=True)
    for _ in range(20):
        time.sleep(0.2)
        if shuffles.size() <= before:
            return
    raise AssertionError(f"{shuffles.size()} shuffles, {before} before")
