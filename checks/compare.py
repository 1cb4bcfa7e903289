"""Run queries and their SQL side by side: python -m checks.compare [sf_dir] [names...]"""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession

from checks.catalog import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()
DUCK_TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("trackuse")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def sorted_rows(rows, columns) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = ((("" if r[i] is None else repr(r[i])) for i in order) for r in rows)
    return sorted(tuple(c) for c in cells)


def compare(con, name: str, df: DataFrame) -> str:
    """``ok``, ``rows only`` or ``FAIL``, with details."""
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        return f"rows only: {len(got)}"
    res = con.execute(ORACLES[name])
    columns = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"FAIL columns {sorted(df.columns)} != {sorted(columns)}"
    duck_types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {ORACLES[name]}").fetchall()}
    wrong = {c: (t, duck_types[c]) for c, t in df.dtypes if DUCK_TYPES.get(t) != duck_types[c]}
    if wrong:
        return f"FAIL types {wrong}"
    a, b = sorted_rows(got, df.columns), sorted_rows(want, columns)
    if a != b:
        extra, missing = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
        return f"FAIL values: {len(a)} rows, {len(b)} expected; only here {extra}; only there {missing}"
    return f"ok {len(a)}"


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con = session(), database(sf)
    failed = 0
    for name in names:
        t = time.time()
        try:
            outcome = compare(con, name, QUERIES[name](spark, sf))
        except Exception as e:  # report and go on with the next query
            outcome = f"FAIL {type(e).__name__}: {str(e)[:600]}"
        failed += outcome.startswith("FAIL")
        print(f"{name}: {outcome} ({time.time() - t:.1f} s)", flush=True)
    print(f"{len(names) - failed} of {len(names)} ok")


if __name__ == "__main__":
    main()
