import datetime as dt

import pytest
from conftest import rows

from trackuse.config import Config
from trackuse.operators.clean import clean_locations, group_range_filter, stationary, time_range
from trackuse.operators.ordering import first_n_per_group

SCHEMA = (
    "individual_local_identifier string, X double, Y double, timestamp string, study_site string, "
    "study_name string, ground_speed double"
)


def fix(bird, lat, when, lon=1.0, site="", speed=0.0):
    return (bird, lon, lat, when, site, "s", speed)


def cleaned(spark, data, **cfg):
    df = spark.createDataFrame(data, SCHEMA)
    out = clean_locations(df, Config(**cfg))
    return sorted(rows(out.select("local_identifier", "timestamp", "location_lat")), key=repr)


def test_site_and_speed_rules(spark):
    data = [
        ("keep", "NL", 0.0), ("keep", "", None), ("keep", "", float("nan")),
        ("drop", "PL", 0.0), ("drop", None, 0.0), ("drop", "NL", 0.1),
    ]
    df = spark.createDataFrame(data, "want string, study_site string, ground_speed double")
    assert [r["want"] for r in stationary(df).collect()] == ["keep"] * 3


def test_range_is_measured_over_all_latitudes_and_missing_names_group(spark):
    data = [
        fix("a", 10.0, "2020-01-01 00:00:01"), fix("a", 50.0, "2020-06-02 00:00:00"),
        fix("b", 10.0, "2020-01-01"), fix("b", 14.9, "2020-01-02"),
        fix(None, 10.0, "2020-01-01"), fix(None, 15.0, "2020-01-02"),
    ]
    got = cleaned(spark, data)
    assert [(r[0], r[2]) for r in got] == [("a", 10.0), (None, 10.0), (None, 15.0)]


def test_period_is_half_open(spark):
    data = [
        fix("a", 10.0, "2013-05-31 23:59:59"), fix("a", 20.0, "2013-06-01"),
        fix("a", 30.0, "2025-05-31 23:59:59"), fix("a", 31.0, "2025-06-01"), fix("a", 32.0, "rubbish"),
    ]
    assert [r[2] for r in cleaned(spark, data)] == [20.0, 30.0]


def test_fix_without_longitude_uses_up_a_slot(spark):
    data = [fix("a", 40.0, "2020-01-02")]
    data += [fix("a", 10.0 + i, f"2020-01-01 0{i}:00:00", lon=None if i == 1 else 1.0) for i in range(6)]
    assert [r[2] for r in cleaned(spark, data)] == [10.0, 12.0, 13.0, 40.0]


def test_both_ends_strict(spark):
    df = spark.createDataFrame([(dt.datetime(2021, 6, d),) for d in (1, 2, 3)], "t timestamp_ntz")
    assert [r["t"].day for r in time_range(df, "t", "2021-06-01", "2021-06-03", "neither").collect()] == [2]
    with pytest.raises(ValueError):
        time_range(df, "t", "2021-06-01", "2021-06-03", "both")


def test_range_filter_ignores_nan_and_drops_empty_groups(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [("a", 1.0), ("a", nan), ("a", 7.0), ("b", nan), ("b", 1.0), ("c", None)], "k string, v double"
    )
    assert {r["k"] for r in group_range_filter(df, "k", "v", 5.0).collect()} == {"a"}


def test_first_n_does_not_depend_on_input_order(spark):
    data = [("a", 1, i % 3, float(i)) for i in range(30)]
    want = None
    for shift in (0, 7, 19):
        df = spark.createDataFrame(data[shift:] + data[:shift], "k string, t int, u int, v double")
        got = sorted(rows(first_n_per_group(df.repartition(4), ["k"], ["t"], 4)))
        want = want or got
        assert got == want == [("a", 1, 0, 0.0), ("a", 1, 0, 3.0), ("a", 1, 0, 6.0), ("a", 1, 0, 9.0)]
