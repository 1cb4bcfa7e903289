"""Tagging effort per year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackuse.functions.season import as_date, as_utc

ID = "individual_local_identifier"


def new_deployments(df: DataFrame, strict: bool = True) -> DataFrame:
    """Animals deployed per year.

    Strict reads dates only: a deployment written with a time of day is not
    counted. ``strict=False`` counts those too.
    """
    year = F.year(as_date(df, "deploy_on_timestamp", strict))
    return (
        df.select(ID, year.alias("deploy_year"))
        .filter(F.col("deploy_year").isNotNull())
        .distinct()
        .groupBy("deploy_year")
        .agg(F.count("*").alias("n_new_deployments"))
    )


def active_tags(df: DataFrame) -> DataFrame:
    """Animals with at least one fix per calendar year."""
    year = F.year(as_utc(df, "timestamp"))
    return (
        df.select(ID, year.alias("deploy_year"))
        .filter(F.col("deploy_year").isNotNull())
        .distinct()
        .groupBy("deploy_year")
        .agg(F.count("*").alias("n_active_tags"))
    )


def recode_metric(name: Column) -> Column:
    return F.when(name == "n_new_deployments", "New deployments").when(
        name == "n_active_tags", "Active tags"
    )


def tag_effort(df: DataFrame, y0: int = 2010, y1: int = 2025, strict: bool = True) -> DataFrame:
    """Both counts per year in long form, with bar labels; latest year first in ``year_order``."""
    counts = ["n_new_deployments", "n_active_tags"]
    wide = (
        new_deployments(df, strict)
        .join(active_tags(df), "deploy_year", "full")
        .filter(F.col("deploy_year").between(y0, y1))
        .select("deploy_year", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
    )
    return (
        wide.withColumn("year_order", F.expr("row_number() OVER (ORDER BY deploy_year DESC)"))
        .unpivot(["deploy_year", "year_order"], counts, "metric", "n")
        .withColumn("metric", recode_metric(F.col("metric")))
        .withColumn("label", F.when(F.col("n") > 0, F.format_number("n", 0)).otherwise(""))
    )
