import datetime as dt
import random

from conftest import rows

from trackuse.operators import outliers
from trackuse.operators.outliers import drop_outliers, flag_outliers

SCHEMA = "id string, timestamp timestamp_ntz, X double, Y double"
START = dt.datetime(2020, 1, 1)


def table(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def walk(seed, n, bird, step):
    rnd = random.Random(seed)
    t, out = START, []
    for _ in range(n):
        t += dt.timedelta(seconds=rnd.choice(step))
        out.append((bird, t, rnd.uniform(0, 50), rnd.uniform(0, 50)))
    return out


def test_slices_give_the_same_rows(spark):
    data = walk(1, 900, "hot", [30, 600, 7200, 90_000]) + walk(2, 40, "cold", [3600])
    data += walk(3, 300, None, [1]) + walk(4, 3, "short", [60])
    data += [("hot", None, float(k), 2.0) for k in range(200)] + [("busy", START, float(k), float(k * k)) for k in range(90)]
    df = table(spark, data)
    args = ("id", ["timestamp"], ["Y", "X"])
    plain = rows(flag_outliers(df, *args, slices=1))
    for slices in (2, 5, 40, 300):
        sliced = rows(flag_outliers(df, *args, slices=slices))
        assert len(sliced) == len(data)
        assert sorted(map(repr, sliced)) == sorted(map(repr, plain))


def test_edges_and_short_series_are_unknown(spark):
    df = table(spark, [("a", START + dt.timedelta(hours=i), float(i), float(i * i)) for i in range(7)])
    df = df.union(table(spark, [("b", START + dt.timedelta(hours=i), float(i), float(i)) for i in range(4)]))
    got = {(r["id"], r["X"]): r["outlier"] for r in flag_outliers(df, "id", ["timestamp"], ["Y", "X"]).collect()}
    assert [got[("a", float(i))] for i in range(7)] == [None, None, "normal", "normal", "normal", None, None]
    assert {got[("b", float(i))] for i in range(4)} == {None}


def test_no_spread_drops_the_row(spark):
    df = table(spark, [("a", START + dt.timedelta(hours=i), float(i), 1.5) for i in range(9)])
    flagged = flag_outliers(df, "id", ["timestamp"], ["Y", "X"])
    assert {r["outlier"] for r in flagged.collect()} == {None}
    assert drop_outliers(flagged).count() == 0


def test_known_or_unknown_follows_three_valued_logic(spark):
    # Y never varies, X jumps: the X outlier is certain, the rest stays unknown
    xs = [0.0, 0.0, 0.1, 100.0, 0.2, 0.3, 0.1]
    df = table(spark, [("a", START + dt.timedelta(hours=i), x, 1.0) for i, x in enumerate(xs)])
    got = {r["X"]: r["outlier"] for r in flag_outliers(df, "id", ["timestamp"], ["Y", "X"]).collect()}
    assert got[100.0] == "outlier"
    assert "normal" not in got.values()


def test_missing_value_empties_its_windows(spark):
    ys = [1.0, 2.0, 4.0, None, 5.0, 7.0, 8.0, 9.5, 11.0, 12.0]
    df = table(spark, [("a", START + dt.timedelta(hours=i), float(i), y) for i, y in enumerate(ys)])
    got = {r["X"]: r["Y_mean_5"] for r in flag_outliers(df, "id", ["timestamp"], ["Y", "X"]).collect()}
    assert [x for x in sorted(got) if got[x] is not None] == [6.0, 7.0]


def test_only_large_keys_are_cut(spark, monkeypatch):
    data = walk(1, 900, "hot", [30, 600, 7200, 90_000]) + walk(2, 40, "cold", [3600]) + walk(3, 300, None, [1]) + walk(5, 99, None, [1])
    args = ("id", ["timestamp"], ["Y", "X"])
    want = sorted(map(repr, rows(flag_outliers(table(spark, data), *args, slices=1))))
    names = []
    plain = outliers.stage
    monkeypatch.setattr(outliers, "stage", lambda df, name: names.append(name) or plain(df, name))
    assert sorted(map(repr, rows(flag_outliers(table(spark, data), *args)))) == want
    assert "outlier-slices" not in names
    for large in (350, 500, 10):
        names.clear()
        monkeypatch.setattr(outliers, "LARGE", large)
        assert sorted(map(repr, rows(flag_outliers(table(spark, data), *args)))) == want
        assert "outlier-slices" in names
