"""Records of CSV files whose quoted texts may hold line breaks, read by many tasks a file.

A line break inside quotes follows an odd number of quote signs. Each block of a file is
counted on its own; the prefix sums of these counts tell every block whether it begins inside a text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackuse.sources.staging import stage

_FOUND = pa.schema([("id", pa.int64()), ("part", pa.int32()), ("begins", pa.bool_()), ("record", pa.string())])


def _batch(at: int, part: int | None, begins: bool, records: pa.Array) -> pa.RecordBatch:
    n = len(records)
    columns = [pa.repeat(at, n), pa.nulls(n) if part is None else pa.repeat(part, n), pa.repeat(begins, n), records]
    return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, _FOUND.types, strict=True)], schema=_FOUND)


def _joined(whole: bool):
    """Joins the lines of each block: the records inside it, or else the pieces of the records that go over its ends."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parity = None, 0
        held: list[str] = []  # lines of a record that has not ended yet
        begins = True  # whether that record began in this block

        def rest() -> Iterator[pa.RecordBatch]:
            if held and not whole:
                yield _batch(at, 1, begins, pa.array(["\n".join(held)], pa.string()))

        for batch in batches:
            ids = batch.column("id").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)] if len(ids) else []
            for a, b in zip(cuts, cuts[1:]):
                lines = batch.column("line").slice(a, b - a)
                new = int(ids[a]) != at
                if new:
                    yield from rest()
                    at, held, parity = int(ids[a]), [], batch.column("open")[a].as_py()
                    begins = parity == 0
                quotes = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)
                after = (parity + np.cumsum(quotes, dtype=np.int64)) % 2
                parity = int(after[-1])
                if new and batch.column("first")[a].as_py():  # the header
                    begins = after[0] == 0
                    lines, after = lines.slice(1), after[1:]
                ends = np.flatnonzero(after == 0) + 1
                if not len(ends):
                    held += lines.to_pylist()
                    continue
                offsets = pa.array([0, *ends.tolist()], pa.int32())
                records = pc.binary_join(pa.ListArray.from_arrays(offsets, lines), "\n")
                if held or not begins:
                    one = pa.array(["\n".join([*held, records[0].as_py()])], pa.string())
                    if begins == whole:
                        yield _batch(at, None if whole else 0, begins, one)
                    records = records.slice(1)
                if whole and len(records):
                    yield _batch(at, None, True, records)
                held, begins = lines.slice(int(ends[-1])).to_pylist(), True
        yield from rest()

    return found


def csv_records(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """``_file, record``: every record of the files, whole, without the first line of each file and blank records.

    Files are split into blocks as any text is; no task holds more than a block, or one
    record. The text is read three times and never shuffled: to count the quote signs of each block, for the
    pieces of the records that go over the ends of blocks, two a block at most, and for all
    other records, which are put together where they are read. Only the pieces are staged and meet by
    their record. One row per block goes to every task. Texts must be quoted
    by the rules: a quote sign inside a value that isn't quoted counts as one that opens a text.
    """
    lines = spark.read.option("lineSep", "\n").text(list(paths)).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line")
    )
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    counts = lines.groupBy("_file", "block").agg(F.sum(quotes).alias("quotes"))
    before = "OVER (PARTITION BY _file ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    blocks = counts.selectExpr(
        "monotonically_increasing_id() AS id", "_file", "block", f"cast(coalesce(sum(quotes) {before}, 0) % 2 AS int) AS open"
    )
    blocks = stage(blocks, "csv-blocks")

    # a broadcast keeps the order of the lines; blocks cut elsewhere than in the count are an error
    placed = lines.join(F.broadcast(blocks), ["_file", "block"], "left").select(
        F.coalesce("id", F.raise_error(F.lit("the blocks of the files changed between two reads"))).alias("id"),
        "open",
        (F.col("block") == 0).alias("first"),
        "line",
    )
    names = F.broadcast(blocks.select("id", "_file", "block"))
    schema = "id long, part int, begins boolean, record string"
    single = placed.mapInArrow(_joined(True), schema).join(names, "id").select("_file", "record")

    pieces = stage(placed.mapInArrow(_joined(False), schema).join(names, "id").drop("id"), "csv-pieces")
    begun = "count_if(begins) OVER (PARTITION BY _file ORDER BY block, part)"
    numbered = pieces.selectExpr("_file", "block", "part", "record", f"{begun} AS number")
    parts = F.array_sort(F.collect_list(F.struct("block", "part", "record")))
    joined = numbered.groupBy("_file", "number").agg(F.array_join(F.transform(parts, lambda p: p["record"]), "\n").alias("record"))
    records = single.unionByName(joined.select("_file", "record"))
    return records.select("_file", F.regexp_replace("record", "\r$", "").alias("record")).where("trim(record) <> ''")
