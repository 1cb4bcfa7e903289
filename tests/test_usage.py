import datetime as dt
import random

import pytest
from conftest import rows

from trackuse.config import Config
from trackuse.operators.effort import active_tags, new_deployments, tag_effort
from trackuse.operators.profile import axis_breaks, map_labels, occupancy, occupancy_roll14, seasonal_profile
from trackuse.operators.recent import recent_cycles
from trackuse.operators.usage import (
    daily_users,
    peak_mode,
    peak_windows,
    presence_days,
    rolling_users,
    site_use_by_year,
    site_use_summary,
)

FIX = "local_identifier string, site_id int, site_name string, site_label string, date date"


def fixes(spark, visits):
    return spark.createDataFrame([(b, s, f"n{s}", f"l{s}", d) for b, s, d in visits], FIX)


def random_visits(seed, n=250):
    rnd = random.Random(seed)
    start = dt.date(2018, 6, 1)
    return [
        (rnd.choice(["a", "b", "c", None]), rnd.randint(1, 3), start + dt.timedelta(days=int(rnd.triangular(0, 800, 30))))
        for _ in range(n)
    ]


@pytest.mark.parametrize("seed", range(4))
def test_sparse_peaks_equal_dense_and_brute_force(spark, seed):
    presence = presence_days(fixes(spark, random_visits(seed, 40 + 80 * seed)))
    sparse = sorted(rows(peak_windows(presence)))
    assert sparse == sorted(rows(peak_windows(presence, dense=True)))
    users = {}
    for bird, site, _, _, _, year, _, day in rows(
        presence.select("local_identifier", "site_id", "site_name", "site_label", "date", "nb_year", "nb_year_start", "day_in_year")
    ):
        users.setdefault((site, year), {}).setdefault(day, set()).add(bird)
    want = {}
    for key, days in users.items():
        sums = {d: sum(len(days.get(k, ())) for k in range(d - 13, d + 1)) for d in range(14, 367)}
        end = max(sums, key=lambda d: (sums[d], -d))
        want[key] = (end, end - 13, sums[end])
    assert {(r[0], r[3]): r[4:7] for r in sparse} == want


def test_all_presence_before_day_14(spark):
    presence = presence_days(fixes(spark, [("a", 1, dt.date(2020, 6, 1)), ("a", 1, dt.date(2020, 6, 2))]))
    (row,) = rows(peak_windows(presence))
    assert row[4:] == (14, 1, 2, "Jun 01 - Jun 14")


def test_repeated_and_unnamed_animals(spark):
    day = dt.date(2020, 7, 1)
    presence = presence_days(fixes(spark, [("a", 1, day), ("a", 1, day), (None, 1, day), (None, 1, day)]))
    daily = daily_users(presence, dense=False)
    assert [r["n_users"] for r in daily.collect()] == [2]
    (use,) = site_use_by_year(presence).collect()
    assert (use["n_site"], use["n_total"], use["prop_site"]) == (2, 2, 1.0)


def test_dense_days_and_rolling_sum(spark):
    presence = presence_days(fixes(spark, [("a", 1, dt.date(2020, 6, 5)), ("b", 1, dt.date(2021, 5, 31))]))
    rolled = {r["day_in_year"]: (r["n_users"], r["roll_14"]) for r in rolling_users(daily_users(presence)).collect()}
    assert len(rolled) == 366
    assert rolled[5] == (1, None) and rolled[14] == (0, 1) and rolled[18] == (0, 1) and rolled[19] == (0, 0)
    assert rolled[365] == (1, 1) and rolled[366] == (0, 1)


def test_leap_cycle_reaches_day_366(spark):
    presence = presence_days(fixes(spark, [("a", 1, dt.date(2020, 5, 31)), ("a", 1, dt.date(2020, 2, 29))]))
    assert sorted(r["day_in_year"] for r in presence.collect()) == [274, 366]


def test_shares_are_between_zero_and_one_and_absent_years_do_not_count(spark):
    presence = presence_days(fixes(spark, random_visits(9)))
    use = site_use_by_year(presence)
    assert all(0 < r["prop_site"] <= 1 for r in use.collect())
    data = [(1, "n", "l", 2018, 1, 2, 0.5), (1, "n", "l", 2020, 2, 2, 1.0), (1, "n", "l", 2021, 1, 5, 0.2)]
    df = spark.createDataFrame(data, use.schema)
    (row,) = site_use_summary(df).collect()
    assert row["prop_median"] == 0.5 and row["n_years"] == 3 and row["prop_mean"] == pytest.approx(1.7 / 3)


def test_usual_window_ties(spark):
    columns = "site_id int, site_name string, site_label string, nb_year int, peak_n_users_14d bigint, peak_window string"
    data = [
        (1, "n", "l", 1, 5, "B"), (1, "n", "l", 2, 5, "B"), (1, "n", "l", 3, 9, "A"),  # most frequent
        (2, "n", "m", 1, 5, "A"), (2, "n", "m", 2, 6, "B"),  # higher mean
        (3, "n", "o", 1, 5, "B"), (3, "n", "o", 2, 5, "A"),  # label
    ]
    got = {r[0]: r[3:] for r in rows(peak_mode(spark.createDataFrame(data, columns)))}
    assert got == {1: ("B", 5.0), 2: ("B", 6.0), 3: ("A", 5.0)}


def test_latest_cycles_come_from_the_fixes(spark):
    visits = [("a", 1, dt.date(y, 7, 1)) for y in (2010, 2015, 2019)]
    assert {r["nb_year"] for r in recent_cycles(fixes(spark, visits), 2).collect()} == {2015, 2019}


def test_seasonal_profile_averages_cycles_with_presence(spark):
    visits = [("a", 1, dt.date(2018, 6, 1)), ("b", 2, dt.date(2018, 6, 2)), ("a", 1, dt.date(2019, 6, 1)), ("a", 1, dt.date(2020, 6, 3))]
    sites = spark.createDataFrame([(1, 10.0), (2, 20.0)], "site_id int, latitude double")
    out = seasonal_profile(presence_days(fixes(spark, visits)), sites)
    got = {(r["site_id"], r["day_in_year"]): (r["prop"], r["site_order"]) for r in out.collect()}
    assert len(got) == 2 * 366
    assert got[(1, 1)] == (0.75, 2) and got[(1, 3)] == (1.0, 2) and got[(2, 2)] == (0.5, 1) and got[(2, 9)] == (0.0, 1)


def test_occupancy_window_counts_rows_not_days(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=2 * i) for i in range(16)]
    clean = spark.createDataFrame([("a", d) for d in days] + [(None, days[0])], "local_identifier string, date date")
    occ = occupancy(clean)
    assert {r["n_tracked"] for r in occ.collect()} == {2}
    got = [r["roll_14"] for r in occupancy_roll14(occ).orderBy("doy").collect()]
    assert got[:13] == [None] * 13 and got[13:] == [7.5, 7.0, 7.0]


def test_effort_counts_and_labels(spark):
    data = [("a", "2012-01-01", "2011-05-05"), ("a", "2012-02-01", "2011-05-05"), ("b", "2012-03-01 10:00:00", "2011-05-05 10:00:00"),
            (None, "2012-03-01", None), ("c", "2009-01-01", "2009-01-01"), ("d", None, "bad")]
    df = spark.createDataFrame(data, "individual_local_identifier string, timestamp string, deploy_on_timestamp string")
    assert sorted(rows(new_deployments(df))) == [(2009, 1), (2011, 1)]
    assert sorted(rows(new_deployments(df, strict=False))) == [(2009, 1), (2011, 2)]
    assert sorted(rows(active_tags(df))) == [(2009, 1), (2012, 3)]
    got = sorted((r["deploy_year"], r["metric"], r["n"], r["label"], r["year_order"]) for r in tag_effort(df).collect())
    assert got == [
        (2011, "Active tags", 0, "", 2), (2011, "New deployments", 1, "1", 2),
        (2012, "Active tags", 3, "3", 1), (2012, "New deployments", 0, "", 1),
    ]


def test_labels_round_half_to_even_and_axis(spark):
    df = spark.createDataFrame([("a", 0.125), ("b", 0.135), ("c", 0.005)], "site_label string, prop_mean double")
    assert [r["label"] for r in map_labels(df).collect()] == ["a: 12%", f"b: {0.135 * 100:.0f}%", f"c: {0.005 * 100:.0f}%"]
    years = spark.createDataFrame([(2013,), (2018,)], "nb_year int")
    assert [r[0] for r in rows(axis_breaks(years))] == [2013, 2015, 2017]


def test_config_anchor_changes_the_cycle(spark):
    presence = presence_days(fixes(spark, [("a", 1, dt.date(2020, 6, 1))]), Config(anchor_month=7, anchor_day=1))
    (row,) = presence.collect()
    assert row["nb_year"] == 2019 and row["day_in_year"] == 337


def test_typed_deployments_count_as_text_does(spark):
    text = spark.createDataFrame([("a", "2011-03-01"), ("b", "2011-03-01 00:00:00"), ("c", "2012-01-02 10:00:00")], "individual_local_identifier string, deploy_on_timestamp string")
    midnight = text.filter("individual_local_identifier <> 'b'")
    for kind in ("timestamp_ntz", "timestamp"):
        typed = midnight.withColumn("deploy_on_timestamp", midnight["deploy_on_timestamp"].cast(kind))
        assert rows(new_deployments(typed)) == rows(new_deployments(midnight)) == [(2011, 1)]
        assert sorted(rows(new_deployments(typed, strict=False))) == [(2011, 1), (2012, 1)]
    dates = midnight.withColumn("deploy_on_timestamp", midnight["deploy_on_timestamp"].try_cast("date"))
    assert sorted(rows(new_deployments(dates))) == [(2011, 1), (2012, 1)]
