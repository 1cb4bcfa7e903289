"""Site centres, names and labels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackuse.fixed_values import REFERENCE_POINTS
from trackuse.functions.project import mercator
from trackuse.operators.ordering import no_nan
from trackuse.sources.staging import stage


FIRST_BITS, MORE_BITS = 13, 12  # of a value's fraction, told apart by the first narrowing and by each later one
NARROWINGS = 5  # 13 + 4 * 12 bits: more than the 52 of a double
FEW = 10_000  # rows of a bin that are ranked in one task


def _digits(value: Column, rounds: int) -> Column:
    """The leading bits of a number, as a long that never falls as the number rises.

    Without rounds: sign, binary exponent and ``FIRST_BITS`` bits of the fraction. With
    more rounds: sign and that many more bits, without the exponent. Numbers below 2**-1000 in size
    have the bits of zero.
    """
    size = F.abs(value)
    exponent = F.least(F.greatest(F.floor(F.log2(size)), F.lit(-1000)), F.lit(1023)).cast("long")
    # the logarithm may be one off next to a power of two: such numbers join the next bin
    fraction = F.least(F.greatest(size * F.pow(F.lit(2.0), -exponent), F.lit(1.0)), F.lit(2.0 - 2.0**-52))
    bits = F.floor((fraction - 1) * 2.0 ** (FIRST_BITS + MORE_BITS * rounds))
    found = bits if rounds else (exponent + 1001) * (1 << FIRST_BITS) + bits
    zero = F.lit(0).cast("long")
    return F.when(size < 2.0**-1000, zero).when(value < 0, -1 - found).otherwise(found)


def _middle(values: DataFrame, bins: Sequence[str], within: Sequence[str]) -> DataFrame:
    """The bins of ``values`` that hold a middle rank: ``n`` values between ``lo`` and ``hi``, ``start`` before them."""
    along = Window.partitionBy(*within).orderBy(F.col(bins[-1]).asc_nulls_last())
    counted = values.groupBy(*bins, "start", "low", "high").agg(
        F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    counted = counted.withColumn("upto", F.col("start") + F.sum("n").over(along)).withColumn("start", F.col("upto") - F.col("n"))
    return counted.where("n > 0 AND upto >= low AND start < high").drop("upto")


def _same(bins: Sequence[str]) -> Column:
    return reduce(lambda p, q: p & q, [F.col(f"v.{c}").eqNullSafe(F.col(f"m.{c}")) for c in bins])


def grouped_median(df: DataFrame, key: str, cols: Sequence[str], bin_width: float = 0.001) -> DataFrame:
    """Exact median per group (mean of the two middle values), nulls and NaN ignored; null for a group without values.

    Values are counted in bins of ``bin_width``, which combines before the shuffle, and the
    one or two bins that hold the middle ranks are located. Where such a bin has more
    than ``FEW`` rows of different values, a radix selection narrows it by the leading bits
    of its values: at most five times, as a double has no more bits. The rows of
    what is left are ranked, so a task that ranks holds ``FEW`` rows of a bin, whatever
    the group and however dense its values. Every narrowing reads ``df``, so stage it if it is
    costly to compute.
    """
    pairs = [F.struct(F.lit(c).alias("axis"), no_nan(df, c).alias("value")) for c in cols]
    values = df.select(F.col(key).alias("group"), F.inline(F.array(*pairs)))
    bins = ["group", "axis", "bin"]
    values = values.withColumn("value", F.col("value").cast("double")).withColumn("bin", F.floor(F.col("value") / bin_width))
    total = values.groupBy("group", "axis").agg(F.count("value").alias("total"))
    # the two middle ranks; equal when the total is odd
    ranks = total.selectExpr("`group`", "axis", "(total + 1) div 2 AS low", "(total + 2) div 2 AS high", "0L AS start")
    ranks = stage(ranks, "median-ranks")
    ranked = values.where("value IS NOT NULL").alias("v").join(ranks.alias("m"), _same(bins[:2]))
    middle = stage(_middle(ranked.select("v.*", "m.low", "m.high", "m.start"), bins, bins[:2]), "middle-bins")
    dense = (F.col("n") > FEW) & (F.col("lo") < F.col("hi"))
    picked = []
    for round_ in range(NARROWINGS + 1):
        # bins of one value need no ranking
        one = middle.where("lo = hi").selectExpr("`group`", "axis", "lo AS value", "start + 1 AS first", "start + n AS last", "low", "high")
        few = middle.where((F.col("lo") < F.col("hi")) & (F.lit(round_ == NARROWINGS) | ~dense))
        inside = Window.partitionBy(*bins).orderBy("value")
        rows = (
            values.alias("v")
            .join(few.alias("m"), _same(bins))
            .groupBy(*[F.col(f"v.{c}") for c in bins], "start", "low", "high", "value")
            .agg(F.count("*").alias("n"))
            .withColumn("last", F.col("start") + F.sum("n").over(inside))
            .withColumn("first", F.col("last") - F.col("n") + 1)
        )
        picked += [one, rows.select(*one.columns)]
        many = middle.where(dense)
        if round_ == NARROWINGS or many.isEmpty():
            break
        name = f"bin{round_ + 1}"
        kept = values.alias("v").join(many.alias("m"), _same(bins)).select("v.*", "m.low", "m.high", "m.start")
        kept = kept.withColumn(name, _digits(F.col("value"), round_))
        middle = stage(_middle(kept, [*bins, name], bins), "middle-bins")
        values, bins = values.withColumn(name, _digits(F.col("value"), round_)), [*bins, name]
    at_rank = lambda rank: F.max(F.when(F.col(rank).between(F.col("first"), F.col("last")), F.col("value")))
    medians = reduce(DataFrame.unionByName, picked).groupBy("group", "axis").agg(((at_rank("low") + at_rank("high")) / 2).alias("median"))
    found = ranks.alias("v").join(medians.alias("m"), _same(["group", "axis"]), "left").select("v.group", "v.axis", "median")
    return found.groupBy(F.col("group").alias(key)).agg(
        *[F.max(F.when(F.col("axis") == c, F.col("median"))).alias(c) for c in cols]
    )


def site_centres(fixes: DataFrame, lon: str = "location_long", lat: str = "location_lat") -> DataFrame:
    """One row per site with the median longitude and latitude of its fixes."""
    return grouped_median(fixes, "site_id", [lon, lat]).select(
        "site_id", F.col(lon).alias("longitude"), F.col(lat).alias("latitude")
    )


def nearest_reference(
    sites: DataFrame, refs: Sequence[tuple[str, float, float]] = REFERENCE_POINTS
) -> DataFrame:
    """Add the nearest named place and the distance to it in Mercator km.

    ``refs`` is a literal list, so it is compared inside the row and nothing is
    joined. Mercator metres are stretched away from the equator; kept as is.
    """
    fallback = F.concat(F.lit("site_"), F.col("site_id").cast("string"))
    if not refs:
        return sites.withColumns({"site_name": fallback, "match_dist_km": F.lit(None).cast("double")})
    points = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                F.lit(name).alias("name"),
                mercator(F.lit(lon), F.lit(lat))[0].alias("x"),
                mercator(F.lit(lon), F.lit(lat))[1].alias("y"),
            )
            for i, (name, lat, lon) in enumerate(dict.fromkeys(refs))
        ]
    )
    mx, my = mercator("longitude", "latitude")

    def ranked(p):
        dx, dy = p["x"] - F.col("_mx"), p["y"] - F.col("_my")
        return F.struct((dx * dx + dy * dy).alias("d2"), p["i"].alias("i"), p["name"].alias("name"))

    return (
        sites.withColumns({"_mx": mx, "_my": my})
        .withColumn("_near", F.array_min(F.transform(points, ranked)))
        .withColumn("site_name", F.when(F.col("_mx").isNull(), fallback).otherwise(F.col("_near.name")))
        .withColumn("match_dist_km", F.sqrt("_near.d2") / 1000)
        .drop("_mx", "_my", "_near")
    )


def label_duplicates(sites: DataFrame) -> DataFrame:
    """Add ``site_label``: the name, with the site number where names repeat.

    ``sites`` is read twice. Names are counted before the shuffle, so a name that
    very many sites share is no large group.
    """
    names = sites.groupBy(F.col("site_name").alias("_name")).agg(F.count("*").alias("_same"))
    numbered = F.concat("site_name", F.lit(" (site "), F.col("site_id").cast("string"), F.lit(")"))
    label = F.when(F.col("_same") > 1, numbered).otherwise(F.col("site_name"))
    counted = sites.join(names, sites["site_name"].eqNullSafe(names["_name"]), "left")
    return counted.withColumn("site_label", label).drop("_same", "_name")


def site_locations(
    fixes: DataFrame, refs: Sequence[tuple[str, float, float]] = REFERENCE_POINTS
) -> DataFrame:
    return label_duplicates(stage(nearest_reference(site_centres(fixes), refs), "named-sites"))


def name_fixes(fixes: DataFrame, sites: DataFrame) -> DataFrame:
    """Attach names to fixes. ``sites`` should be staged: its size decides the join."""
    return fixes.join(sites.select("site_id", "site_name", "site_label"), "site_id", "left")
