import random

from conftest import rows
from pyspark.sql import functions as F

from trackuse.fixed_values import DROPPED_COLUMNS
from trackuse.operators import ingest
from trackuse.operators.ingest import (
    clean_import,
    dedup_first,
    drop_all_null,
    drop_any,
    exclude_taxa,
    join_deployments,
    reorder,
    select_studies,
    union_studies,
)
from trackuse.operators.outliers import drop_outliers, flag_outliers

NAN = float("nan")


def test_null_in_any_tested_column_drops_the_study(spark):
    data = [(1, "a", "t", "x"), (2, None, "t", "x"), (3, "a", None, "x"), (4, "a", "t", None), (5, "no", "t", "x"), (6, "a", "t", "CC_0")]
    df = spark.createDataFrame(data, "id int, name string, taxon_ids string, license_type string")
    assert [r["id"] for r in select_studies(df, "t", ["no"]).collect()] == [1]


def test_join_matches_nulls_and_renames_clashes(spark):
    fixes = spark.createDataFrame(
        [("s", "a", 1), ("s", None, 2), (None, "a", 3), ("s", "z", 4)],
        "study_name string, individual_local_identifier string, v int",
    )
    deps = spark.createDataFrame(
        [("s", "a", 10, "p"), ("s", None, 20, "q"), ("s", None, 21, "r"), (None, "a", 30, "t")],
        "study_name string, individual_local_identifier string, v int, extra string",
    )
    out = join_deployments(fixes, deps)
    assert out.columns == ["study_name", "individual_local_identifier", "v", "v_dep", "extra"]
    assert sorted(r[2:] for r in rows(out) if r[2] != 4) == [(1, 10, "p"), (2, 20, "q"), (2, 21, "r"), (3, 30, "t")]
    assert [r[2:] for r in rows(out) if r[2] == 4] == [(4, None, None)]


def test_all_null_columns(spark):
    df = spark.createDataFrame([(1, None, NAN, None, ""), (2, None, None, True, None)], "a int, b string, c double, d boolean, `e.f` string")
    assert drop_all_null(df).columns == ["a", "d", "e.f"]
    assert drop_all_null(df.limit(0)).columns == []


def test_drop_reorder_and_taxa(spark):
    df = spark.createDataFrame([(1, 2, 3, "islandica"), (4, 5, 6, None), (7, 8, 9, "other")], "visible int, b int, a int, taxon_detail string")
    assert drop_any(df).columns == ["b", "a", "taxon_detail"]
    assert reorder(df, ["a", "taxon_detail"]).columns == ["a", "taxon_detail", "visible", "b"]
    assert [r["a"] for r in exclude_taxa(df).collect()] == [9]


def test_union_fills_missing_columns(spark):
    a, b = spark.sql("SELECT 1 AS x, 'p' AS y"), spark.sql("SELECT 2 AS x, true AS z")
    assert rows(union_studies([a, b])) == [(1, "p", None), (2, None, True)]


def test_first_full_row_wins(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "c"), ("k", 1, "d"), (None, 5, "e")], "k string, o int, v string")
    assert sorted(rows(dedup_first(df, ["k"], ["o"])), key=repr) == [("k", 1, "c"), (None, 5, "e")]


def test_import_equals_join_then_dedup(spark):
    rnd = random.Random(5)
    ids = ["a", "b", None]
    fixes = [
        (rnd.choice(["s", "t"]), rnd.choice(ids), f"2020-01-{rnd.randint(1, 28):02d} 0{rnd.randint(0, 9)}:00:00",
         rnd.uniform(0, 9), rnd.uniform(0, 9), rnd.choice(["ok", "islandica", None, "ok", "ok"]), None, NAN, 1)
        for _ in range(400)
    ]
    fixes = spark.createDataFrame(
        fixes,
        "study_name string, individual_local_identifier string, timestamp string, X double, Y double, "
        "taxon_detail string, empty string, nan double, visible int",
    )
    deps = spark.createDataFrame(
        [("s", "a", "2019-02-01", 1, None, None), ("s", "a", "2019-01-01", 2, None, 4.0), ("s", None, None, 3, None, 5.0),
         ("s", None, "2019-01-01", 4, "later", None), ("t", "b", "2019-01-01", 5, None, 6.0), ("t", "zz", "2019-01-01", 6, "x", 7.0)],
        "study_name string, individual_local_identifier string, deploy_on_timestamp string, deployment_id int, "
        "note string, visible double",
    )
    keys = ["study_name", "individual_local_identifier"]
    typed = fixes.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    joined = drop_all_null(join_deployments(typed, deps))
    dep_order = ["deploy_on_timestamp", "deployment_id", "note", "visible_dep"]
    unique = dedup_first(joined, [*keys, "timestamp"], dep_order)
    shaped = exclude_taxa(reorder(unique.drop(*DROPPED_COLUMNS)))
    want = drop_outliers(flag_outliers(shaped, "individual_local_identifier", ["timestamp"], ["Y", "X"]))
    got = clean_import(fixes, deps)
    assert got.columns == want.columns
    assert "note" in got.columns and "empty" not in got.columns and "nan" not in got.columns
    assert got.count() > 50
    assert sorted(map(repr, rows(got))) == sorted(map(repr, rows(want)))


def test_column_filled_only_late_is_kept(spark):
    df = spark.range(5_000).selectExpr("id", "CASE WHEN id = 4999 THEN 1.5D ELSE double('NaN') END AS late", "CAST(NULL AS INT) AS never")
    assert drop_all_null(df).columns == ["id", "late"]


def test_fixes_are_computed_once(spark, monkeypatch):
    plans = []
    plain = ingest.stage
    monkeypatch.setattr(ingest, "stage", lambda df, name: plans.append(df) or plain(df, name))
    text = spark.range(60).selectExpr(
        "'s' AS study_name", "'a' AS individual_local_identifier", "concat('2020-01-01 00:', lpad(id, 2, '0'), ':00') AS timestamp",
        "(id * 7919 % 101) / 10D AS X", "(id * 104729 % 97) / 10D AS Y", "'ok' AS taxon_detail", "CAST(NULL AS STRING) AS empty",
    )
    deps = spark.createDataFrame([("s", "a", "2019-01-01")], "study_name string, individual_local_identifier string, deploy_on_timestamp string")
    got = clean_import(text, deps)
    reads = [df._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 60") for df in [*plans, got]]
    assert sum(reads) == 1 and "empty" not in got.columns and "deploy_on_timestamp" in got.columns


def test_many_pairs_of_one_key_are_split(spark, monkeypatch):
    monkeypatch.setattr(ingest, "PAIRS_PER_PIECE", 100, raising=False)
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    kept = {n: spark.conf.get(n) for n in names}
    fix_rows = [("s", None, i) for i in range(300)] + [("s", "a", 300), (None, "a", 301), (None, None, 302), ("s", "z", 303)] + [("s", None, 7)] * 2
    dep_rows = [("s", None, 100 + i) for i in range(5)] + [("s", "a", 1), ("s", "a", 2), (None, "a", 3)]
    fixes = spark.createDataFrame(fix_rows, "study_name string, individual_local_identifier string, v int")
    deps = spark.createDataFrame(dep_rows, "study_name string, individual_local_identifier string, v int")
    want = []
    for f in fix_rows:
        want += [(*f, d[2]) for d in dep_rows if d[:2] == f[:2]] or [(*f, None)]
    for n, v in zip(names, ("false", "-1")):
        spark.conf.set(n, v)
    try:
        out = join_deployments(fixes, deps)
        assert out.columns == ["study_name", "individual_local_identifier", "v", "v_dep"]
        assert sorted(rows(out), key=repr) == sorted(want, key=repr)
        unnamed = out.where("study_name = 's' and individual_local_identifier is null")
        assert unnamed.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        for n, v in kept.items():
            spark.conf.set(n, v)


def test_fixes_of_a_large_key_meet_arrays_of_deployments(spark, monkeypatch):
    """Also of deployments that are equal; without further columns their number still counts."""
    monkeypatch.setattr(ingest, "PAIRS_PER_PIECE", 50, raising=False)
    monkeypatch.setattr(ingest, "DEPLOYMENTS_PER_ARRAY", 3, raising=False)
    met = []
    plain = ingest._attached
    monkeypatch.setattr(ingest, "_attached", lambda fixes, deps, *args: met.append(deps) or plain(fixes, deps, *args))
    fix_rows = [("s", None, i) for i in range(20)] + [("s", "a", 300), (None, "a", 301), ("s", "z", None)]
    dep_rows = [("s", None, 1)] * 7 + [("s", None, 2), ("s", None, None), ("s", "a", 1), ("s", "a", 1), (None, "a", 3), ("t", "a", 4)]
    schema = "study_name string, individual_local_identifier string, `v.w` int"
    fixes, deps = spark.createDataFrame(fix_rows, schema), spark.createDataFrame(dep_rows, schema)
    want = []
    for f in fix_rows:
        want += [(*f, d[2]) for d in dep_rows if d[:2] == f[:2]] or [(*f, None)]
    out = join_deployments(fixes, deps)
    assert out.columns == [*fixes.columns, "v.w_dep"] and sorted(rows(out), key=repr) == sorted(want, key=repr)
    sizes = met[-1].where("study_name = 's' and individual_local_identifier is null and _piece = 0").selectExpr("size(_deployments) AS n")
    assert max(r.n for r in sizes.collect()) <= 3 and sum(r.n for r in sizes.collect()) == 9
    bare = join_deployments(fixes, deps.drop("`v.w`").drop("v.w"))
    assert bare.columns == fixes.columns and sorted(rows(bare), key=repr) == sorted((w[:3] for w in want), key=repr)


def test_fixes_are_not_shuffled_to_meet_few_deployments(spark, monkeypatch):
    plans = {}
    plain = ingest.stage
    monkeypatch.setattr(ingest, "stage", lambda df, name: plans.update({name: df}) or plain(df, name))
    text = spark.range(60).selectExpr(
        "'s' AS study_name", "'a' AS individual_local_identifier", "concat('2020-01-01 00:', lpad(id, 2, '0'), ':00') AS timestamp",
        "(id * 7919 % 101) / 10D AS X", "(id * 104729 % 97) / 10D AS Y", "'ok' AS taxon_detail",
    )
    deps = spark.createDataFrame([("s", "a", "2019-01-01")], "study_name string, individual_local_identifier string, deploy_on_timestamp string")
    clean_import(text, deps)
    plan = plans["imported"]._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
