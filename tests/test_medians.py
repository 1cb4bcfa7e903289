"""Medians of groups whose values lie very close together."""

import random
import statistics

import pytest
from conftest import rows

from trackuse.operators import sites
from trackuse.operators.sites import grouped_median


def digits(spark, values, rounds):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    return [r[0] for r in df.coalesce(1).select(sites._digits(df["v"], rounds)).collect()]


def test_digits_never_fall_and_tell_all_doubles_apart(spark):
    rng = random.Random(1)
    values = sorted(
        [rng.uniform(-10, 10) for _ in range(300)]
        + [s * 2.0**k * f for s in (1, -1) for k in (-999, -60, -1, 0, 1, 3, 52, 1000) for f in (1.0, 1 - 2.0**-53, 1 + 2.0**-52)]
        + [0.0, -0.0, float("inf"), float("-inf"), 5e-324, 1.7e308]
    )
    found = digits(spark, values, 0)
    assert found == sorted(found)
    # numbers of one exponent are apart once all bits are read
    near = sorted({8 + k * 2.0**-49 for k in range(200)})
    assert len(set(digits(spark, near, sites.NARROWINGS - 1))) == len(near)
    assert digits(spark, [-v for v in near], 2) == sorted(digits(spark, [-v for v in near], 2), reverse=True)


@pytest.mark.parametrize("few", [0, 3, 10_000])
def test_dense_bins(spark, monkeypatch, few):
    monkeypatch.setattr(sites, "FEW", few)
    rng = random.Random(few)
    groups = {
        "dense": [8.0 + rng.randrange(1 << 20) * 2.0**-49 for _ in range(401)],
        "negative": [-9.0 - rng.random() * 1e-9 for _ in range(300)],
        "around zero": [rng.choice((-1, 1)) * 10.0 ** -rng.randrange(5, 40) for _ in range(200)],
        "ties": [1.5] * 50 + [1.5000001] * 50,
        "wide": [rng.uniform(-1e300, 1e300) for _ in range(101)],
        "one": [3.25],
        "none": [None, float("nan")],
        None: [0.1, 0.1, 0.3],
    }
    data = [(k, v, -1.0) for k, vs in groups.items() for v in vs]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k string, v double, w double")
    got = {r["k"]: (r["v"], r["w"]) for r in grouped_median(df, "k", ["v", "w"]).collect()}
    for k, vs in groups.items():
        usable = [v for v in vs if v is not None and v == v]
        assert got[k] == (statistics.median(usable) if usable else None, -1.0), k


def test_no_task_ranks_more_than_a_few_rows(spark, monkeypatch):
    """100,000 values in one bin of 0.001 degrees: what is ranked stays below the bound."""
    ranked = []
    plain = sites._middle

    def seen(values, bins, within):
        found = plain(values, bins, within)
        ranked.append(found)
        return found

    monkeypatch.setattr(sites, "_middle", seen)
    df = spark.range(100_001).selectExpr("1 AS site", "8.0001D + id * 1e-9D AS lon")
    assert rows(grouped_median(df, "site", ["lon"])) == [(1, 8.0001 + 50_000 * 1e-9)]
    sizes = [f.agg({"n": "max"}).first()[0] for f in ranked]
    assert sizes[0] == 100_001 and sizes[-1] <= sites.FEW and len(sizes) <= 1 + sites.NARROWINGS


def test_no_rows(spark):
    assert grouped_median(spark.createDataFrame([], "k string, v double"), "k", ["v"]).count() == 0
