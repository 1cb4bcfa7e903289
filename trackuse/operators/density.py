"""Density clustering of lattice cells.

All distances are between integer cells, so ``distance <= radius`` is exact.
Work is cut into square tiles of the map. A tile and its halo hold a fixed
number of cells at most, however many fixes fall into them, so no task can grow
with the data. Its memory grows with the radius: 2 MB for counts at 120 cells,
144 MB at 1,000.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackuse.operators.components import connected_components
from trackuse.sources.staging import stage


def _radius_sq(radius: float) -> int:
    return math.floor(radius * radius + 1e-9)


def _tile_side(reach: int) -> int:
    return max(256, 4 * reach)


def _tile(c: str, side: int) -> Column:
    return F.floor(F.col(c) / side)


def _into_tiles(cells: DataFrame, side: int, reach: int) -> DataFrame:
    """One row per cell and tile whose halo holds it (about 2.25 per cell)."""

    def span(c: str) -> Column:
        low, high = (F.floor((F.col(c) + d) / side) for d in (-reach, reach))
        return F.explode(F.sequence(low, high))

    return (
        cells.withColumn("tx", span("gx"))
        .withColumn("ty", span("gy"))
        .withColumn("home", (F.col("tx") == _tile("gx", side)) & (F.col("ty") == _tile("gy", side)))
    )


def _disc_counts(cells_x, cells_y, at_x, at_y, extent: int, reach: int, radius_sq: int):
    """Number of cells within the radius of each (at_x, at_y), tile-local indices.

    Row prefix sums make every lattice row of the disc one subtraction.
    """
    prefix = np.zeros((extent, extent + 1), dtype=np.int32)
    prefix[cells_y, cells_x + 1] = 1
    np.cumsum(prefix, axis=1, out=prefix)
    total = np.zeros(len(at_x), dtype=np.int64)
    for dy in range(-reach, reach + 1):
        wide = math.isqrt(radius_sq - dy * dy)
        total += prefix[at_y + dy, at_x + wide + 1] - prefix[at_y + dy, at_x - wide]
    return total


def neighbour_count(cells: DataFrame, radius: float, method: str = "tiles") -> DataFrame:
    """Distinct cells (``gx``, ``gy``) with ``neighbours`` within ``radius``, itself included.

    ``tiles`` counts in numpy per tile. ``sweep`` stays in SQL: each cell adds one
    to an interval of every lattice row in reach, and a running sum reads it off;
    it shuffles two rows per lattice row in reach instead of about two per cell.
    """
    if method == "sweep":
        return _neighbour_sweep(cells, radius)
    radius_sq = _radius_sq(radius)
    reach = math.isqrt(radius_sq)
    side = _tile_side(reach)

    def count(key: tuple, tile: pd.DataFrame) -> pd.DataFrame:
        x = tile["gx"].to_numpy() - (key[0] * side - reach)
        y = tile["gy"].to_numpy() - (key[1] * side - reach)
        home = tile["home"].to_numpy()
        n = _disc_counts(x, y, x[home], y[home], side + 2 * reach, reach, radius_sq)
        return tile.loc[home, ["gx", "gy"]].assign(neighbours=n)

    tiled = _into_tiles(cells.select("gx", "gy"), side, reach)
    return tiled.groupBy("tx", "ty").applyInPandas(count, "gx bigint, gy bigint, neighbours bigint")


def _neighbour_sweep(cells: DataFrame, radius: float) -> DataFrame:
    radius_sq = _radius_sq(radius)
    reach = math.isqrt(radius_sq)
    dy = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    wide = F.floor(F.sqrt(F.lit(radius_sq) - F.col("dy") * F.col("dy")))
    ends = (
        cells.select("gx", "gy", dy.alias("dy"))
        .select("gx", (F.col("gy") + F.col("dy")).alias("row"), wide.alias("w"))
        .select(
            "row",
            F.inline(
                F.array(
                    F.struct((F.col("gx") - F.col("w")).alias("x"), F.lit(1).alias("step")),
                    F.struct((F.col("gx") + F.col("w") + 1).alias("x"), F.lit(-1).alias("step")),
                )
            ),
        )
        .groupBy("row", "x")
        .agg(F.sum("step").alias("step"))
    )
    asked = cells.select(F.col("gy").alias("row"), F.col("gx").alias("x"), F.lit(0).alias("step"), F.lit(True).alias("ask"))
    running = Window.partitionBy("row").orderBy("x").rangeBetween(Window.unboundedPreceding, 0)
    return (
        ends.withColumn("ask", F.lit(False))
        .unionByName(asked)
        .withColumn("neighbours", F.sum("step").over(running))
        .filter("ask")
        .select(F.col("x").alias("gx"), F.col("row").alias("gy"), "neighbours")
    )


def _block(c: str, side: int) -> Column:
    return F.floor(F.col(c) / side)


def _node(bx: Column, by: Column) -> Column:
    """Block coordinates in one long."""
    return F.shiftleft(bx, 32) + by + F.lit(2**31)


def _core_blocks(core: DataFrame, side: int) -> DataFrame:
    """Blocks so small that all their core cells are mutual neighbours.

    Kept per block: its first core cell, and for every lattice row and column
    the outermost core cells. Only those can be nearest to another block.
    """
    placed = core.select(
        _block("gx", side).alias("bx"), _block("gy", side).alias("by"), "gx", "gy"
    )
    rows = (
        placed.groupBy("bx", "by", "gy")
        .agg(F.min("gx").alias("low"), F.max("gx").alias("high"))
        .groupBy("bx", "by")
        .agg(
            F.collect_list(F.struct(F.col("gy").alias("at"), "low", "high")).alias("by_row"),
            F.min(F.struct(F.col("low").alias("gx"), "gy")).alias("first_cell"),
        )
    )
    columns = (
        placed.groupBy("bx", "by", "gx")
        .agg(F.min("gy").alias("low"), F.max("gy").alias("high"))
        .groupBy("bx", "by")
        .agg(F.collect_list(F.struct(F.col("gx").alias("at"), "low", "high")).alias("by_column"))
    )
    return rows.join(columns, ["bx", "by"]).withColumn("node", _node(F.col("bx"), F.col("by")))


def _block_links(blocks: DataFrame, side: int, radius_sq: int) -> DataFrame:
    """Pairs of blocks with core cells within the radius of each other.

    A block meets only the few blocks in reach (half of them, as links go both
    ways), by an equi-join on block coordinates.
    """

    def gap(o: int) -> int:
        return 0 if o == 0 else (abs(o) - 1) * side + 1

    far = math.isqrt(radius_sq) // side + 1
    offsets = [
        (ox, oy)
        for ox in range(0, far + 1)
        for oy in range(-far, far + 1)
        if (ox > 0 or oy > 0) and gap(ox) ** 2 + gap(oy) ** 2 <= radius_sq
    ]
    if not offsets:
        return blocks.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    steps = F.array(*[F.struct(F.lit(ox).alias("ox"), F.lit(oy).alias("oy")) for ox, oy in offsets])
    left = (
        blocks.select("bx", "by", "node", "by_row", "by_column", F.inline(steps))
        .select(
            (F.col("bx") + F.col("ox")).alias("bx"),
            (F.col("by") + F.col("oy")).alias("by"),
            F.col("node").alias("a"),
            "ox",
            # side by side: rows face each other; stacked: columns do
            F.when(F.col("ox") > 0, F.col("by_row")).otherwise(F.col("by_column")).alias("mine"),
        )
    )
    right = blocks.select("bx", "by", F.col("node").alias("b"), "by_row", "by_column")
    theirs = F.when(F.col("ox") > 0, F.col("by_row")).otherwise(F.col("by_column"))

    def close(p: Column, q: Column) -> Column:
        across, along = q["low"] - p["high"], q["at"] - p["at"]
        return across * across + along * along <= radius_sq

    near = F.exists("mine", lambda p: F.exists("theirs", lambda q: close(p, q)))
    return left.join(right, ["bx", "by"]).withColumn("theirs", theirs).filter(near).select("a", "b")


def _number_clusters(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """Blocks with ``site_id``: 1, 2, ... by each cluster's first core cell.

    First cells are ranked within vertical strips of the map, and each strip
    starts after the clusters of the strips to its left. Only strip totals, one
    row per strip, are added up in a single task.
    """
    placed = blocks.join(labels, "node").select("bx", "by", "label", "first_cell")
    firsts = (
        placed.groupBy("label")
        .agg(F.min("first_cell").alias("first_cell"))
        .withColumn("strip", F.floor(F.col("first_cell.gx") / 1024))
    )
    before = Window.orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)
    strips = (
        firsts.groupBy("strip")
        .agg(F.count("*").alias("n"))
        .select("strip", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    )
    rank = F.row_number().over(Window.partitionBy("strip").orderBy("first_cell"))
    numbered = firsts.join(strips, "strip").select(
        "label", (F.col("before") + rank).cast("int").alias("site_id")
    )
    return placed.join(numbered, "label").select("bx", "by", "site_id")


def _border_sites(core: DataFrame, others: DataFrame, radius_sq: int) -> DataFrame:
    """Non-core cells with the lowest-numbered cluster in reach, 0 if none."""
    reach = math.isqrt(radius_sq)
    side = _tile_side(reach)

    def claim(key: tuple, tile: pd.DataFrame) -> pd.DataFrame:
        x = tile["gx"].to_numpy() - (key[0] * side - reach)
        y = tile["gy"].to_numpy() - (key[1] * side - reach)
        site = tile["site_id"].to_numpy()
        asking = site == 0
        out = tile.loc[asking, ["gx", "gy"]].assign(site_id=np.int32(0))
        if not asking.any():
            return out
        ax, ay = x[asking], y[asking]
        found = np.zeros(len(ax), dtype=np.int32)
        by_site = np.argsort(site, kind="stable")[int(asking.sum()) :]
        numbers, starts = np.unique(site[by_site], return_index=True)
        along = np.argsort(ax, kind="stable")  # asking cells from west to east
        for s, mine in zip(numbers, np.split(by_site, starts[1:])):
            # only the box of the cluster and what is in reach of it
            west, south = x[mine].min(), y[mine].min()
            width, height = x[mine].max() - west, y[mine].max() - south
            ends = np.searchsorted(ax[along], [west - reach, west + width + reach + 1])
            near = along[ends[0] : ends[1]]
            near = near[(found[near] == 0) & (ay[near] >= south - reach) & (ay[near] <= south + height + reach)]
            if len(near):
                move = 2 * reach
                n = _disc_counts(
                    x[mine] - west + move, y[mine] - south + move, ax[near] - west + move, ay[near] - south + move,
                    int(max(width, height)) + 4 * reach + 1, reach, radius_sq,
                )
                found[near[n > 0]] = s
        return out.assign(site_id=found)

    asking = others.select(
        "gx", "gy", F.lit(0).alias("site_id"), _tile("gx", side).alias("tx"), _tile("gy", side).alias("ty")
    )
    claimed = _into_tiles(core, side, reach).drop("home").unionByName(asking)
    return claimed.groupBy("tx", "ty").applyInPandas(claim, "gx bigint, gy bigint, site_id int")


def dbscan(cells: DataFrame, radius: float, min_pts: int) -> DataFrame:
    """Cluster number ``site_id`` per distinct cell (``gx``, ``gy``); 0 is noise.

    A cell is core when at least ``min_pts`` cells, itself included, lie within
    ``radius``. Clusters are numbered by their smallest core cell in (gx, gy)
    order. A border cell in reach of several clusters goes to the lowest number.
    """
    radius_sq = _radius_sq(radius)
    side = math.isqrt(radius_sq // 2) + 1
    counted = stage(neighbour_count(cells, radius), "neighbours")
    core = counted.filter(F.col("neighbours") >= min_pts).select("gx", "gy")
    others = counted.filter(F.col("neighbours") < min_pts).select("gx", "gy")
    blocks = stage(_core_blocks(core, side), "core-blocks")
    linked = connected_components(_block_links(blocks, side, radius_sq), "a", "b")
    labels = blocks.select("node").join(linked, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    numbered = _number_clusters(blocks, labels)
    core_sites = stage(
        core.withColumns({"bx": _block("gx", side), "by": _block("gy", side)})
        .join(numbered, ["bx", "by"])
        .select("gx", "gy", "site_id"),
        "core-sites",
    )
    return core_sites.unionByName(_border_sites(core_sites, others, radius_sq))


def assign_sites(fixes: DataFrame, labelled_cells: DataFrame) -> DataFrame:
    """Fixes with the ``site_id`` of their cell; noise is removed.

    A nest or roost may put very many fixes in one cell: the join is left to
    Spark, which splits such a partition (adaptive skew join).
    """
    sites = labelled_cells.filter(F.col("site_id") != 0).select("gx", "gy", "site_id")
    return fixes.join(sites, ["gx", "gy"])
