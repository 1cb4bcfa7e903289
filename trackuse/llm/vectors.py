"""Vectors of floating-point entries as vectors of whole numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHOLE = 2.0**52  # entries at or beyond this size, after scaling, are not told apart to the unit by a double


def whole_entries(vector: Column, factor: int, offset: int = 0) -> Column:
    """``floor(factor * c) + offset`` of every entry c, as long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * factor) + F.lit(offset).cast("long"))


def usable(vector: Column, factor: int) -> Column:
    """True if the vector has entries and all are finite and below 2**52 after scaling; never null."""
    entry = lambda c: F.coalesce(F.abs(c.cast("double")) * factor < WHOLE, F.lit(False))
    # NaN is larger than every number
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, entry), F.lit(False))


def of_full_length(rows: DataFrame, column: str) -> tuple[DataFrame, int]:
    """The rows whose vector is as long as the longest one, and that length (0 without rows)."""
    longest = rows.agg(F.max(F.size(column))).first()[0] or 0
    return rows.where(F.size(column) == longest), longest
