"""Intermediate tables in the folder all executors share.

A staged table cuts lineage, survives the loss of executors, and has a known
file size: Spark then broadcasts it in later joins only if it is below
``spark.sql.autoBroadcastJoinThreshold`` and shuffles it otherwise.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only on ``local``."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="trackuse-"))
    return sc.getCheckpointDir().rstrip("/")


def application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/trackuse-{spark.sparkContext.applicationId}"


def stage(df: DataFrame, name: str, free_shuffles: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    All tables of one application lie in one folder, to be removed after it
    with ``cleanup``, or one by one with ``discard``. ``free_shuffles`` collects the driver's
    garbage, so that Spark drops the shuffle files behind the table at once, not some time later.
    As Spark's event queue keeps the last query until another one ends, a query of one row comes first.
    """
    spark = df.sparkSession
    path = f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if free_shuffles:
        spark.range(1).count()
        spark.sparkContext._jvm.System.gc()
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_path = path
    return staged


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(staged: DataFrame) -> None:
    """Delete a table made by ``stage`` that nothing reads any more."""
    _delete(staged.sparkSession, staged.staged_path)


def cleanup(spark: SparkSession) -> None:
    """Delete every staged table of this application."""
    _delete(spark, application_dir(spark))
