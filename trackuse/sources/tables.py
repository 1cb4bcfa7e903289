"""Reading and writing locations, study exports and derived tables."""

from __future__ import annotations

import csv
from collections.abc import Iterable, Iterator, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackuse.fixed_values import REFERENCE_POINTS, REQUIRED_COLUMNS, TAG_SITES
from trackuse.sources.layout import by_cycle_and_place
from trackuse.sources.records import csv_records
from trackuse.sources.staging import stage

LOCATION_SCHEMA = T.StructType(
    [
        T.StructField("individual_local_identifier", T.StringType()),
        T.StructField("X", T.DoubleType()),
        T.StructField("Y", T.DoubleType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("study_site", T.StringType()),
        T.StructField("study_name", T.StringType()),
        T.StructField("ground_speed", T.DoubleType()),
        T.StructField("deploy_on_timestamp", T.StringType()),
    ]
)
_CSV = {"nullValue": "NA", "escape": '"'}
_TYPES = {f.name: f.dataType for f in LOCATION_SCHEMA.fields}


def require_columns(df: DataFrame, cols: Iterable[str] = REQUIRED_COLUMNS) -> DataFrame:
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


AHEAD = 1 << 10  # lines read between two looks whether a task may end


def _first_lines(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """``file, header``: the first line of every file that has one, staged.

    A session of its own gives every file a task of its own, which ends with the first line.
    Until Python has answered Spark reads ahead; of what it reads only one line in ``AHEAD`` goes
    on, emptied, so that the task soon sees the answer.
    """
    own = spark.newSession()
    whole = str(1 << 60)
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        own.conf.set(name, whole)
    own.conf.set("spark.sql.files.maxPartitionNum", (1 << 31) - 1)
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.slice(0, 1)
            return

    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # in the task, so in the file
    lines = own.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("value"), place.alias("place"))
    seen = lines.where(F.col("place") % AHEAD == 0).select("file", F.when(F.col("place") == 0, F.col("value")).alias("header"))
    found = stage(seen.mapInArrow(firsts, "file string, header string").repartition("file"), "csv-headers")
    return spark.read.schema(found.schema).parquet(found.staged_path)


def _typed(raw: DataFrame, columns: dict[str, Column], problems: Observation | None) -> DataFrame:
    """The columns by name, known ones cast; ``problems`` counts the values that are no number as the rows pass."""
    typed = raw.select("_file", *[c.alias(n) for n, c in columns.items()])
    known = [n for n in columns if n in _TYPES and _TYPES[n] != T.StringType()]
    cast = {n: F.col(f"`{n}`").try_cast(_TYPES[n]) for n in known}
    if problems and known:
        bad = [F.count_if(F.col(f"`{n}`").isNotNull() & c.isNull()).alias(n) for n, c in cast.items()]
        typed = typed.observe(problems, *bad)
    return typed.select(*[cast.get(n, F.col(f"`{n}`")).alias(n) for n in columns], "_file")


def _read_csv(
    spark: SparkSession,
    paths: Iterable[str],
    headers: DataFrame,
    multi_line: bool = False,
    problems: Observation | None = None,
) -> DataFrame:
    """CSV with a header. ``NA`` and blanks are null, a quoted ``""`` is text.

    Files may list columns in any order and lack some. All are read in one scan, by
    place; a file's header in ``headers``, of which only the distinct ones come to the driver, gives the names. Column
    types are never guessed: an all-digit identifier stays text. Known columns are
    cast by name; a malformed number becomes null and is counted in ``problems``, which
    has a count per column after the first action on the table.
    ``multi_line`` allows line breaks inside quoted texts; files are still split (``records``), but read
    three times. Adds ``_file``.
    """
    paths = list(paths)
    lines = sorted(r["header"] for r in headers.select("header").distinct().collect())
    if not lines:
        raise ValueError(f"no header in {', '.join(paths)}")
    names = [next(csv.reader([line.lstrip("\ufeff")])) for line in lines]
    places = [f"c{i}" for i in range(max(map(len, names)))]
    schema = T.StructType([T.StructField(p, T.StringType()) for p in places])
    if multi_line:
        parsed = F.from_csv("record", schema.simpleString()[len("struct<") : -1].replace(":", " "), _CSV)
        raw = csv_records(spark, paths).select(parsed.alias("_row"), "_file").select("_row.*", "_file")
    else:
        raw = spark.read.schema(schema).options(header=True, **_CSV).csv(paths)
        raw = raw.select("*", F.col("_metadata.file_path").alias("_file"))
    if len(lines) == 1:
        columns = {n: F.col(p) for n, p in zip(names[0], places)}
    else:
        raw = raw.join(headers.withColumnRenamed("file", "_file"), "_file")
        columns = {n: F.lit(None).cast("string") for own in names for n in own}
        for line, own in zip(lines, names, strict=True):
            for n, p in zip(own, places):
                columns[n] = F.when(F.col("header") == line, F.col(p)).otherwise(columns[n])
    return _typed(raw, columns, problems)


def read_locations(
    spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = False, problems: Observation | None = None
) -> DataFrame:
    """The location table; fails early when a required column is missing."""
    if fmt == "csv":
        rows = _read_csv(spark, [path], _first_lines(spark, [path]), multi_line, problems)
        return require_columns(rows.drop("_file"))
    return require_columns(spark.read.format(fmt).load(path))


def _qualified(spark: SparkSession, path: str) -> str:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()


def read_studies(
    spark: SparkSession,
    paths: Mapping[str, str],
    fmt: str = "csv",
    multi_line: bool = False,
    problems: Observation | None = None,
) -> DataFrame:
    """Landed exports, ``{study name: path}``, stacked with their study name.

    CSV files are read in one scan, however many studies and headers there
    are, and get their study from their path; paths must be files or folders
    without wildcards. Serves fixes and deployments alike.
    """
    if fmt != "csv":
        return union_studies(
            spark.read.format(fmt).load(path).withColumn("study_name", F.lit(name)) for name, path in paths.items()
        )
    places = spark.createDataFrame([(n, _qualified(spark, p)) for n, p in paths.items()], "study_name string, _place string")
    headers = _first_lines(spark, paths.values())
    rows = _read_csv(spark, paths.values(), headers, multi_line, problems)
    if "study_name" in rows.columns:
        rows = rows.drop("study_name")
    # a landed path is the file itself or its folder; each file meets its study before the rows do
    folder = F.regexp_replace("file", "/[^/]*$", "")
    at = F.explode(F.array_distinct(F.array("file", folder)))
    files = headers.select(F.col("file").alias("_file"), at.alias("_place")).join(places, "_place").select("_file", "study_name")
    return rows.join(stage(files, "csv-studies"), "_file").drop("_file")


def union_studies(dfs: Iterable[DataFrame]) -> DataFrame:
    """Stack tables by column name; a column a study lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def write_locations(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Parquet is written by cycle and place (``layout``), so that boxes and periods prune it.

    CSV keeps line breaks of texts; read them back with ``multi_line``.
    """
    if fmt == "csv":
        df.write.mode("overwrite").options(header=True, **_CSV).csv(path)
        return
    if {"X", "Y", "timestamp"} <= set(df.columns):
        df = by_cycle_and_place(df)
    df.write.mode("overwrite").format(fmt).save(path)


def write_outputs(
    tables: Mapping[str, DataFrame], directory: str, partition_by: Mapping[str, str] | None = None
) -> None:
    """One Parquet folder per table, partitioned where asked.

    Rebalancing gathers each partition value into few files, and splits a value
    that is too large for one task.
    """
    for name, df in tables.items():
        column = (partition_by or {}).get(name)
        writer = (df.hint("rebalance", column) if column else df).write.mode("overwrite")
        (writer.partitionBy(column) if column else writer).parquet(f"{directory}/{name}")


def read_output(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}")


def reference_points(spark: SparkSession, points=REFERENCE_POINTS) -> DataFrame:
    return spark.createDataFrame(
        list(dict.fromkeys(points)), "site_name string, ref_lat double, ref_long double"
    )


def tag_sites(spark: SparkSession, sites=TAG_SITES) -> DataFrame:
    return spark.createDataFrame(list(sites), "tag_site string, lon double, lat double")
