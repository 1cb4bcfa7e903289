"""Reading CSV: headers, records over several lines and blocks, values that are no numbers."""

import csv
import random

import pytest
from conftest import rows
from pyspark.sql import Observation

from trackuse.sources import records
from trackuse.sources.records import csv_records
from trackuse.sources.tables import _first_lines, read_locations, read_studies

HEADER = ["individual_local_identifier", "X", "Y", "timestamp", "study_site", "study_name", "ground_speed", "deploy_on_timestamp", "notes"]


@pytest.fixture
def small_blocks(spark):
    """Text is read in blocks of two kilobytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    kept = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "2048")
    yield
    for n, v in kept.items():
        spark.conf.set(n, v)


def written(path, records, end="\n", header=HEADER):
    with open(path, "w", newline="") as file:
        out = csv.writer(file, quoting=csv.QUOTE_MINIMAL, lineterminator=end)
        out.writerow(header)
        out.writerows(records)


def record(rng, i, text):
    return [f"{i:05d}", str(rng.randrange(90)), str(i), "2021-06-01 10:00:00", "NL", "s", "0.5", "2020-01-01", text]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_over_lines_and_blocks(spark, tmp_path, small_blocks, end):
    rng = random.Random(len(end))
    texts = ["plain", "two\nlines", 'quo"ted', '"\n"', "a,b\n\n\nc", "x" * 3_000, "line\n" * 2_000, "", '""\n,"']
    records = [record(rng, i, rng.choice(texts)) for i in range(400)]
    path = tmp_path / "all"
    path.mkdir()
    written(path / "a.csv", records[:300], end)
    written(path / "b.csv", records[300:], end)
    (path / "empty.csv").write_text("")
    written(path / "only_header.csv", [], end)
    back = read_locations(spark, str(path), multi_line=True)
    got = {r["individual_local_identifier"]: (r["Y"], r["notes"] or "") for r in back.collect()}
    assert got == {r[0]: (float(r[2]), r[8]) for r in records} and back.count() == len(records)
    blocks = spark.read.text(str(path)).rdd.getNumPartitions()
    assert blocks > 20


def test_equal_lines_and_blank_records(spark, tmp_path, small_blocks):
    (tmp_path / "t.csv").write_text('h\n"a\nb"\n"a\nb"\n\n   \nc\nc\n"open\nto the end')
    got = sorted(r["record"] for r in csv_records(spark, [str(tmp_path / "t.csv")]).collect())
    assert got == sorted(['"a\nb"', '"a\nb"', "c", "c", '"open\nto the end'])


def test_one_header_for_each_file_that_has_one(spark, tmp_path, small_blocks):
    rng = random.Random(3)
    written(tmp_path / "large.csv", [record(rng, i, "x" * 200) for i in range(500)])
    (tmp_path / "other.csv").write_text("\ufeffa,b\n")
    (tmp_path / "empty.csv").write_text("")
    found = {r["file"].rsplit("/", 1)[1]: r["header"] for r in _first_lines(spark, [str(tmp_path)]).collect()}
    assert found == {"large.csv": ",".join(HEADER), "other.csv": "a,b"}
    assert _first_lines(spark, [str(tmp_path / "empty.csv")]).count() == 0


def test_one_scan_whatever_the_headers(spark, tmp_path):
    rng = random.Random(4)
    paths = {}
    for k in range(4):
        header = HEADER[:]
        rng.shuffle(header)
        header = header[: len(header) - k]
        places = [HEADER.index(n) for n in header]
        written(tmp_path / f"{k}.csv", [[r[p] for p in places] for r in (record(rng, k * 10 + i, "t") for i in range(5))], header=header)
        paths[f"study {k}"] = str(tmp_path / f"{k}.csv")
    back = read_studies(spark, paths)
    assert back.count() == 20 and set(back.columns) == {*HEADER}
    plan = back._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" csv") == 1
    got = {(r["study_name"], r["Y"]) for r in back.where("Y is not null").collect()}
    assert all(int(n.split()[1]) == int(y) // 10 for n, y in got) and len(got) >= 5


@pytest.mark.parametrize("multi_line", [False, True])
def test_values_that_are_no_numbers_are_counted(spark, tmp_path, multi_line):
    lines = [",".join(HEADER), "a,1,2,t,NL,s,0,d,", "b,x,2,t,NL,s,NA,d,", "c,y,z,t,NL,s,,d,", "d,1,2,t,NL,s,0 km,d,"]
    (tmp_path / "in.csv").write_text("\n".join(lines) + "\n")
    problems = Observation("bad values")
    back = read_locations(spark, str(tmp_path / "in.csv"), multi_line=multi_line, problems=problems)
    assert sorted(r["individual_local_identifier"] for r in back.collect()) == ["a", "b", "c", "d"]
    assert problems.get == {"X": 2, "Y": 1, "ground_speed": 1}
    again = Observation()
    read_studies(spark, {"s": str(tmp_path / "in.csv")}, problems=again).count()
    assert again.get["X"] == 2


def test_only_records_over_block_ends_are_staged(spark, tmp_path, small_blocks, monkeypatch):
    staged, plain = {}, records.stage
    monkeypatch.setattr(records, "stage", lambda df, name: staged.setdefault(name, plain(df, name)))
    rng = random.Random(5)
    written(tmp_path / "t.csv", [record(rng, i, 'two\n"lines"') for i in range(1_000)])
    found = csv_records(spark, [str(tmp_path / "t.csv")])
    assert found.count() == 1_000 and found.distinct().count() == 1_000
    blocks = staged["csv-blocks"].count()
    assert 20 < blocks and staged["csv-pieces"].count() <= 2 * blocks
    assert found.where("record like '%two\n%lines%'").count() == 1_000


def test_rows_meet_their_study_without_a_shuffle(spark, tmp_path):
    rng = random.Random(6)
    paths = {}
    for k, header in enumerate((HEADER, HEADER[::-1])):
        data = [[r[HEADER.index(n)] for n in header] for r in (record(rng, i, "t" * 200) for i in range(500))]
        written(tmp_path / f"{k}.csv", data, header=header)
        paths[f"study {k}"] = str(tmp_path / f"{k}.csv")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "40000")  # less than the files have
    try:
        back = read_studies(spark, paths)
        plan = back._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
        assert sorted(rows(back.groupBy("study_name").count())) == [("study 0", 500), ("study 1", 500)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
