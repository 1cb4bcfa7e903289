"""From study exports to one tidy location table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackuse.fixed_values import DROPPED_COLUMNS, EXCLUDED_TAXA, LEADING_COLUMNS
from trackuse.functions.season import as_utc
from trackuse.operators.ordering import first_n_per_group, no_nan, same_key
from trackuse.operators.outliers import drop_outliers, flag_outliers
from trackuse.sources.staging import discard, stage
from trackuse.sources.tables import union_studies

__all__ = [
    "clean_import",
    "dedup_first",
    "drop_all_null",
    "drop_any",
    "exclude_taxa",
    "join_deployments",
    "reorder",
    "select_studies",
    "union_studies",
]

STUDY_KEYS = ("study_name", "individual_local_identifier")
PAIRS_PER_PIECE = 4_000_000
DEPLOYMENTS_PER_ARRAY = 1_000


def select_studies(
    studies: DataFrame,
    taxon: str,
    exclude_names: Sequence[str],
    exclude_licenses: Sequence[str] = ("CC_0",),
) -> DataFrame:
    """Studies of one taxon; a null in any tested column drops the row."""
    return studies.filter(
        (F.col("taxon_ids") == taxon)
        & ~F.col("name").isin(*exclude_names)
        & ~F.col("license_type").isin(*exclude_licenses)
    )


def _attached(fixes: DataFrame, deps: DataFrame, on: Sequence[str], suffix: str) -> DataFrame:
    """Left join where null keys match and clashing names get ``suffix``."""
    named = deps.select(
        *[F.col(k).alias(f"_key_{k}") for k in on],
        *[
            F.col(f"`{c}`").alias(f"{c}{suffix}" if c in fixes.columns else c)
            for c in deps.columns
            if c not in on
        ],
    )
    pairs = [(k, f"_key_{k}") for k in on]
    return fixes.join(named, same_key(fixes, named, pairs), "left").drop(*[b for _, b in pairs])


def _large_keys(fixes: DataFrame, deps: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys, as ``_large_...``, whose pairs are too many for one task, the ``_pieces`` and the ``_arrays`` they need, staged."""
    repeated = deps.groupBy(*[F.col(k).alias(f"_large_{k}") for k in on]).agg(F.count(F.lit(1)).alias("_deps")).where("_deps > 1")
    sizes = fixes.groupBy(*on).agg(F.count(F.lit(1)).alias("_fixes"))
    met = sizes.join(repeated, same_key(sizes, repeated, [(k, f"_large_{k}") for k in on])).drop(*on)
    pieces = F.ceil(F.col("_fixes") * F.col("_deps") / PAIRS_PER_PIECE)
    arrays = F.ceil(F.col("_deps") / DEPLOYMENTS_PER_ARRAY)
    met = met.select(*[f"_large_{k}" for k in on], pieces.cast("int").alias("_pieces"), arrays.cast("int").alias("_arrays"))
    return stage(met.where("_pieces > 1"), "large-keys")


def join_deployments(
    fixes: DataFrame, deps: DataFrame, on: Sequence[str] = STUDY_KEYS, suffix: str = "_dep"
) -> DataFrame:
    """Left join where null keys match and clashing names get ``suffix``.

    Every fix without a name meets every deployment without one in its study;
    reduce ``deps`` to one row per key first where that is not wanted. The fixes of a key with
    very many pairs are split by a hash of the row into pieces, each of which meets all deployments
    of the key, so that no task makes them all. Deployments then come in arrays, so that a fix is
    joined once for many of them. The keys of ``fixes`` are read once more to count them.
    """
    large = _large_keys(fixes, deps, on)
    if large.isEmpty():
        return _attached(fixes, deps, on, suffix)
    keys = [f"_large_{k}" for k in on]

    def dealt(df: DataFrame, to: str, name: str) -> DataFrame:
        """``df`` with ``_pieces``, and as ``name`` one of as many numbers as the column ``to`` says, by a hash of the row."""
        hashed = [f"`{f.name}`" for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
        of_row = F.coalesce(F.pmod(F.xxhash64(*hashed), F.col(to)), F.lit(0)).cast("int")
        df = df.join(large, same_key(df, large, list(zip(on, keys))), "left").drop(*keys)
        return df.withColumn(name, of_row).drop("_arrays")

    split = dealt(fixes, "_pieces", "_piece").drop("_pieces")
    names = {c: f"{c}{suffix}" if c in fixes.columns else c for c in deps.columns if c not in on}
    values = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)]
    group = [*on, "_pieces", "_array"]
    # equal rows have one hash
    nth = F.row_number().over(Window.partitionBy(*group).orderBy("_array"))
    numbered = dealt(deps, "_arrays", "_array").withColumn("_nth", F.floor((nth - 1) / DEPLOYMENTS_PER_ARRAY))
    packed = numbered.groupBy(*group, "_nth").agg(F.collect_list(F.struct(*values or [F.lit(1)])).alias("_deployments"))
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1))
    copies = packed.select(*on, every.alias("_piece"), "_deployments")
    met = _attached(split, copies, [*on, "_piece"], suffix)
    own = [F.col(f"`{c}`") for c in fixes.columns]
    met = met.select(*own, F.explode_outer("_deployments").alias("_deployment"))
    return met.select(*own, *[F.col("_deployment").getField(f"_{i}").alias(n) for i, n in enumerate(names.values())])


def _fill_tests(df: DataFrame) -> list[Column]:
    return [F.max(no_nan(df, c).isNotNull()).alias(f"c{i}") for i, c in enumerate(df.columns)]


def filled_columns(df: DataFrame) -> list[str]:
    """Columns with a value in at least one row, found in one pass.

    ``NaN`` is no value. Without rows no column is filled.
    """
    if not df.columns:
        return []
    return [c for c, flag in zip(df.columns, df.agg(*_fill_tests(df)).head()) if flag]


def _staged_with_filled(df: DataFrame, name: str) -> tuple[DataFrame, list[str]]:
    """``df`` staged, and its filled columns, observed while it is written: ``df`` is computed once."""
    seen = Observation()
    staged = stage(df.observe(seen, *_fill_tests(df)), name)
    return staged, [c for i, c in enumerate(df.columns) if seen.get.get(f"c{i}")]


def drop_all_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in filled_columns(df)])


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """First full row per key under a total order (not just any row)."""
    return first_n_per_group(df, keys, order, 1)


def drop_any(df: DataFrame, cols: Sequence[str] = DROPPED_COLUMNS) -> DataFrame:
    return df.drop(*cols)


def reorder(df: DataFrame, first: Sequence[str] = LEADING_COLUMNS) -> DataFrame:
    return df.select(*first, *[F.col(f"`{c}`") for c in df.columns if c not in first])


def exclude_taxa(
    df: DataFrame, col: str = "taxon_detail", values: Sequence[str] = EXCLUDED_TAXA
) -> DataFrame:
    """Drop listed taxa; a null taxon is dropped too."""
    return df.filter(~F.col(col).isin(*values))


def clean_import(
    fixes: DataFrame,
    deps: DataFrame,
    suffix: str = "_dep",
    drop: Sequence[str] = DROPPED_COLUMNS,
    taxa: Sequence[str] = EXCLUDED_TAXA,
) -> DataFrame:
    """Fixes with deployment data, without duplicates, foreign taxa and outliers.

    The result keeps one row per study, individual and time, so of several
    deployments only the first can survive. Reducing deployments to that row
    before the join avoids multiplying fixes; which deployment columns count as
    empty is still judged over every deployment that meets a fix. Fixes are read and
    parsed once, and staged.
    """
    on = list(STUDY_KEYS)
    fixes, kept = _staged_with_filled(fixes.withColumn("timestamp", as_utc(fixes, "timestamp")), "import-fixes")
    fix_keys = fixes.select(*on).distinct()
    met = deps.join(fix_keys, same_key(deps, fix_keys, [(k, k) for k in on]), "left_semi")
    filled = [c for c in filled_columns(met) if c not in on]
    order = ["deploy_on_timestamp"] if "deploy_on_timestamp" in deps.columns else []
    first_dep = dedup_first(deps, on, order)
    # names may clash only with fix columns that are themselves dropped as empty
    first_dep = first_dep.select(*on, *[F.col(f"`{c}`").alias(f"{c}{suffix}" if c in fixes.columns else c) for c in filled])
    first_dep = stage(first_dep, "first-deployments")  # its size decides whether the fixes are shuffled to meet it

    empty = [c for c in fixes.columns if c not in kept]
    tidy = fixes.drop(*[c for c in empty if c not in STUDY_KEYS])
    # rows of one study and individual get the same deployment, so it can't decide between them
    unique = dedup_first(tidy, [*on[::-1], "timestamp"])
    joined = _attached(unique, first_dep, on, suffix)  # one row per key: nothing to split
    # read more than once below
    shaped = stage(exclude_taxa(reorder(drop_any(joined, drop)), values=taxa), "imported")
    discard(fixes)
    return drop_outliers(flag_outliers(shaped, "individual_local_identifier", ["timestamp"], ["Y", "X"]))
