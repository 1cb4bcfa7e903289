"""Order in which locations are written, so that boxes and periods skip what they don't need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackuse.functions.season import as_utc, cycle_year
from trackuse.operators.ordering import no_nan

CURVE_BITS = 16  # along each axis: about 600 m


def _spread(bits: Column) -> Column:
    """The 16 bits of a number with a zero before each."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        bits = bits.bitwiseOR(F.shiftleft(bits, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return bits


def curve_key(lon: Column, lat: Column) -> Column:
    """Place on a curve that fills the map: the bits of both axes in turns, so near places are mostly near on it."""
    steps = 1 << CURVE_BITS
    scaled = lambda c, half: F.least(F.greatest(F.floor((c + half) / (2 * half) * steps), F.lit(0)), F.lit(steps - 1))
    return _spread(scaled(lon, 180.0)).bitwiseOR(F.shiftleft(_spread(scaled(lat, 90.0)), 1))


def by_cycle_and_place(df: DataFrame, lon: str = "X", lat: str = "Y", time: str = "timestamp") -> DataFrame:
    """Rows in ranges of cycle, then place on the map, then time, and sorted within each.

    Files and row groups then hold small boxes of short periods, and their minima and
    maxima let ``clip_box`` and ``time_range`` skip most. A place with very many rows
    is split by time. Rows without a time or a place come first. Sampling for the ranges reads ``df`` twice.
    """
    when = as_utc(df, time)
    keys = [cycle_year(when), curve_key(no_nan(df, lon), no_nan(df, lat)), when]
    named = {f"_layout_{i}": k for i, k in enumerate(keys)}
    order = [F.col(n).asc_nulls_first() for n in named]
    return df.withColumns(named).repartitionByRange(*order).sortWithinPartitions(*order).drop(*named)
