import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from trackuse.functions.season import as_utc, cycle_day_label, parse_date, parse_timestamp, with_cycle, wrap_day

TEXTS = {
    "2021-06-01 10:20:30": dt.datetime(2021, 6, 1, 10, 20, 30),
    "2021-06-01 10:20:30.125": dt.datetime(2021, 6, 1, 10, 20, 30, 125000),
    "2021-06-01T10:20:30Z": dt.datetime(2021, 6, 1, 10, 20, 30),
    "2021-06-01 10:20:30+02:00": dt.datetime(2021, 6, 1, 8, 20, 30),
    "2021-06-01": dt.datetime(2021, 6, 1),
    "2020-02-29": dt.datetime(2020, 2, 29),
    "2021-02-29": None,
    "2021-13-01 00:00:00": None,
    "2021": None,
    "2021-06": None,
    "2021-06-01 10:20": None,
    "": None,
    "unknown": None,
}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_parse_timestamp(spark, zone):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = dict(rows(df.select("t", parse_timestamp("t"))))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == TEXTS


def test_typed_columns_are_not_parsed(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2021-06-01 10:00:00' AS a, TIMESTAMP'2021-06-01 10:00:00Z' AS b, DATE'2021-06-01' AS c")
    got = rows(df.select(*[as_utc(df, c) for c in "abc"]))[0]
    assert got == (dt.datetime(2021, 6, 1, 10), dt.datetime(2021, 6, 1, 10), dt.datetime(2021, 6, 1))


def test_strict_date_rejects_a_time_of_day(spark):
    df = spark.createDataFrame([("2021-06-01",), ("2021-06-01 10:00:00",), (None,)], "t string")
    day = dt.date(2021, 6, 1)
    assert [r[0] for r in rows(df.select(parse_date("t")))] == [day, None, None]
    assert [r[0] for r in rows(df.select(parse_date("t", strict=False)))] == [day, day, None]


@pytest.mark.parametrize("anchor", [(6, 1), (1, 1), (9, 15)])
def test_cycle_against_datetime(spark, anchor):
    days = [dt.date(2019, 1, 1) + dt.timedelta(days=i) for i in range(0, 1200)]
    df = with_cycle(spark.createDataFrame([(d,) for d in days], "date date"), "date", *anchor)
    for date, year, start, index in rows(df):
        began = dt.date(date.year, *anchor)
        began = began if date >= began else dt.date(date.year - 1, *anchor)
        assert (year, start, index) == (began.year, began, (date - began).days + 1)


def test_labels_and_wrapping(spark):
    df = spark.range(-20, 380).select("id", cycle_day_label(F.col("id")).alias("label"), wrap_day(F.col("id")).alias("w"))
    got = {i: (label, w) for i, label, w in rows(df)}
    for i in range(1, 367):
        day = dt.date(2001, 6, 1) + dt.timedelta(days=i - 1)
        assert got[i] == (day.strftime("%b %d"), i)
    assert got[274][0] == "Mar 01" and got[366][0] == "Jun 01"
    assert got[0][1] == 366 and got[-12][1] == 354 and got[367][1] == 1
