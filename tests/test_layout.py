"""Locations written by cycle and place."""

import datetime as dt
import random
from pathlib import Path

import pyarrow.parquet as pq
from conftest import rows
from pyspark.sql import functions as F

from trackuse.operators.clean import time_range
from trackuse.operators.regions import clip_box
from trackuse.sources.layout import curve_key
from trackuse.sources.tables import read_locations, write_locations

COLUMNS = "individual_local_identifier string, X double, Y double, timestamp timestamp_ntz, study_site string, study_name string, ground_speed double, deploy_on_timestamp string"


def test_curve_takes_the_bits_in_turns(spark):
    rng = random.Random(1)
    places = [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(200)] + [(-180.0, -90.0), (180.0, 90.0), (999.0, -999.0)]
    df = spark.createDataFrame(places, "x double, y double").select("*", curve_key(F.col("x"), F.col("y")).alias("key"))
    for x, y, key in rows(df):
        a, b = (min(max(int((c + h) / (2 * h) * 65536 // 1), 0), 65535) for c, h in ((x, 180), (y, 90)))
        assert key == sum((a >> i & 1) << 2 * i | (b >> i & 1) << 2 * i + 1 for i in range(16))


def test_a_box_and_a_period_read_few_row_groups(spark, tmp_path):
    rng = random.Random(2)
    start = dt.datetime(2015, 1, 1)
    data = [
        (f"b{i % 7}", rng.uniform(-20, 20), rng.uniform(0, 50), start + dt.timedelta(hours=rng.randrange(50_000)), "s", "n", 0.0, None)
        for i in range(20_000)
    ]
    # one place with a third of all rows; rows without a place or a time
    data += [("hub", -9.0, 38.8, start + dt.timedelta(minutes=i), "s", "n", 0.0, None) for i in range(10_000)]
    data += [(None, None, 1.0, start, "s", "n", 0.0, None), ("nan", float("nan"), 1.0, start, "s", "n", 0.0, None), ("no time", 1.0, 1.0, None, "s", "n", 0.0, None)]
    df = spark.createDataFrame(data, COLUMNS).repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", "96")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_locations(df, f"{tmp_path}/out")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = read_locations(spark, f"{tmp_path}/out", "parquet")
    assert sorted(map(repr, rows(back))) == sorted(map(repr, rows(df)))

    groups = [g for f in Path(f"{tmp_path}/out").glob("*.parquet") for m in [pq.ParquetFile(f).metadata] for g in map(m.row_group, range(m.num_row_groups))]
    names = [groups[0].column(i).path_in_schema for i in range(groups[0].num_columns)]
    span = lambda g, n: g.column(names.index(n)).statistics
    meets = lambda g, n, low, high: (s := span(g, n)).has_min_max and s.min <= high and s.max >= low
    in_box = [g for g in groups if meets(g, "X", 5, 9) and meets(g, "Y", 40, 44)]
    in_year = [g for g in groups if meets(g, "timestamp", dt.datetime(2018, 6, 1), dt.datetime(2019, 6, 1))]
    assert len(groups) >= 80 and len(in_box) <= len(groups) / 3 and len(in_year) <= len(groups) / 3
    assert max(g.num_rows for g in groups) < 4_000  # the one place is split

    box = clip_box(back, (5.0, 9.0), (40.0, 44.0))
    year = time_range(back, "timestamp", "2018-06-01", "2019-06-01")
    for found, column in ((box, "X"), (year, "timestamp")):
        assert f"GreaterThanOrEqual({column}" in found._jdf.queryExecution().executedPlan().toString()
        assert 0 < found.count() < df.count() / 3
    assert box.count() == sum(1 for r in data if r[1] is not None and 5 <= r[1] <= 9 and 40 <= r[2] <= 44)
