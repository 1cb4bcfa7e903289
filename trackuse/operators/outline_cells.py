"""Country outlines as square cells: cells wholly inside, and border cells with a bounded number of edges.

Outlines are first noded, that is, every corner that lies on another outline's edge
becomes a corner of that edge, so that shared borders are made of equal edges. Then
cells that edges touch are split until few edges are left in each. For every outline
of a border cell it is known whether the cell's south-east corner is inside; from
there a walk north along the east side and west to a point meets only edges of the cell.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackuse.sources.staging import discard, stage

MAX_EDGES = 64  # of a cell, all outlines together, unless it can't be split any more
TOP_CELLS = 64  # along the longer side of the extent of all outlines
FACTOR = 4  # a cell is split into FACTOR x FACTOR cells
DEPTH = 12  # splits
SNAP_M = 0.01  # a corner as near as this lies on an edge
ORIGIN = (-123.456789, -98.7654321)  # of the cells, so that their sides avoid round places
ENDS = ["x1", "y1", "x2", "y2"]
CELL = ["level", "cx", "cy"]


def number(value: float) -> str:
    return f"{value!r}D"


# Expressions are SQL text; ``e`` is what stands before the columns of an edge, "" or "e.".


def line(index: str, side: str, axis: int) -> str:
    """Where the cell of that index begins along an axis."""
    return f"(({index}) * {side} + {number(ORIGIN[axis])})"


def index_of(place: str, side: str, axis: int) -> str:
    return f"floor(({place} - {number(ORIGIN[axis])}) / {side})"


def turn(e: str, x: str, y: str) -> str:
    """Positive if the point is left of the edge, which runs north, or east if level; zero on its line."""
    return f"(({e}x2 - {e}x1) * ({y} - {e}y1) - ({x} - {e}x1) * ({e}y2 - {e}y1))"


def crosses_west(e: str, x: str, y: str, east: str) -> str:
    """Whether the edge lies between the point and the place ``east`` of it; the south end counts, the north end doesn't."""
    return f"({e}y1 <= {y} AND {y} < {e}y2 AND {turn(e, x, y)} > 0 AND {turn(e, east, y)} <= 0)"


def crosses_north(e: str, x: str, south: str, north: str) -> str:
    """Whether the edge passes a line from ``south`` to ``north`` at ``x``; the west end counts, the east end doesn't.

    Where it passes exactly through an end, the same side is taken as by ``crosses_west``.
    """

    def below(y: str) -> str:
        t = turn(e, x, y)
        return f"CASE WHEN {e}x2 <= {e}x1 THEN {t} <= 0 WHEN {e}y2 > {e}y1 THEN {t} > 0 ELSE {t} >= 0 END"

    spans = f"least({e}x1, {e}x2) <= {x} AND {x} < greatest({e}x1, {e}x2)"
    return f"({spans} AND ({below(north)}) <> ({below(south)}))"


def touches(e: str, x: str, y: str) -> str:
    """Whether the point lies on the edge."""
    return (
        f"({turn(e, x, y)} = 0 AND {x} BETWEEN least({e}x1, {e}x2) AND greatest({e}x1, {e}x2)"
        f" AND {y} BETWEEN {e}y1 AND {e}y2)"
    )


def _reach(south: str, north: str) -> tuple[str, str]:
    """How far west and east the edge reaches between two heights, if it is there at all."""
    at = [f"(x1 + (x2 - x1) * coalesce(try_divide(greatest(least({y}, y2), y1) - y1, y2 - y1), 0D))" for y in (south, north)]
    both = ", ".join(at)
    return tuple(f"(CASE WHEN y1 = y2 THEN {f}(x1, x2) ELSE {f}({both}) END)" for f in ("least", "greatest"))


def _row_reach(row: str, side: str) -> tuple[str, str]:
    south = line(row, side, 1)
    return _reach(f"({south} - {SNAP_M}D)", f"({south} + {side} + {SNAP_M}D)")


def _placed(edges: DataFrame, length: float) -> DataFrame:
    """A row for each edge and cell of that side which it touches or nearly touches."""
    side = number(length)
    rows = f"explode(sequence({index_of(f'y1 - {SNAP_M}D', side, 1)}, {index_of(f'y2 + {SNAP_M}D', side, 1)})) AS cy"
    west, east = _row_reach("cy", side)
    columns = f"explode(sequence({index_of(f'{west} - {SNAP_M}D', side, 0)}, {index_of(f'{east} + {SNAP_M}D', side, 0)})) AS cx"
    return edges.selectExpr("*", rows).selectExpr("*", columns)


def _parts(placed: DataFrame, length: float) -> DataFrame:
    """The edges of cells with all parts of the cell: ``kx, ky`` of side ``length``, and whether the edge ``meets`` it."""
    side = number(length)
    parts = placed.selectExpr("*", f"explode(sequence(0, {FACTOR * FACTOR - 1})) AS k").selectExpr(
        "*", f"cx * {FACTOR} + k % {FACTOR} AS kx", f"cy * {FACTOR} + k div {FACTOR} AS ky"
    )
    west, east = _row_reach("ky", side)
    south, left = line("ky", side, 1), line("kx", side, 0)
    margin = f"{side} + {SNAP_M}D"
    meets = (
        f"y1 <= {south} + {margin} AND y2 >= {south} - {SNAP_M}D"
        f" AND {west} <= {left} + {margin} AND {east} >= {left} - {SNAP_M}D AS meets"
    )
    return parts.selectExpr("*", meets).drop("k")


def _with_size(placed: DataFrame) -> DataFrame:
    """``n``: how many edges the cell of each row has. Counts combine before the shuffle and skewed joins are split."""
    return placed.join(placed.groupBy("cx", "cy").agg(F.count("*").alias("n")), ["cx", "cy"])


def top_side(edges: DataFrame, unit: float) -> float:
    """Side of the largest cells: ``unit`` times a power of FACTOR, so that ``TOP_CELLS`` of them span all outlines."""
    box = edges.selectExpr("max(greatest(x1, x2)) - min(least(x1, x2))", "max(y2) - min(y1)").first()
    longest = max((v or 0.0) for v in box)
    return unit * FACTOR ** max(0, ceil(log(max(longest, 1.0) / (TOP_CELLS * unit), FACTOR)))


def northward(edges: DataFrame) -> DataFrame:
    """Edges with their ends in one order: south first, of a level edge the west end."""
    ends = [f"IF(y1 > y2 OR y1 = y2 AND x1 > x2, {b}, {a}) AS {a}" for a, b in zip(ENDS, [*ENDS[2:], *ENDS[:2]])]
    return edges.selectExpr("outline", *ends)


def noded(edges: DataFrame, side: float) -> DataFrame:
    """``edges`` cut at every corner of an edge that lies on them, within ``SNAP_M``; ``shared`` if an even number are equal.

    Edges meet in cells that are split until they are few, so a cell gives a bounded
    number of pairs. A cut edge runs through the corner itself: it may bend by that much.
    """
    placed, used = _placed(edges, side), []
    for level in range(DEPTH + 1):
        placed = stage(_with_size(placed).withColumn("level", F.lit(level)), "outline-edges")
        used.append(placed)
        many = placed.where(F.col("n") > MAX_EDGES)
        if level == DEPTH or many.isEmpty():
            break
        side /= FACTOR
        parts = _parts(many, side).where("meets")
        placed = parts.select("outline", *ENDS, F.col("kx").alias("cx"), F.col("ky").alias("cy"))
    leaves = [t.where(F.col("n") <= MAX_EDGES) for t in used[:-1]] + used[-1:]
    together = reduce(DataFrame.unionByName, leaves)
    corners = together.selectExpr(*CELL, "inline(array(struct(x1 AS px, y1 AS py), struct(x2 AS px, y2 AS py)))").distinct()
    length = "sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))"
    near = together.join(corners, CELL).selectExpr(
        "outline", *ENDS, f"((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / {length} AS along", "px", "py"
    )
    on_it = f"abs({turn('', 'px', 'py')}) <= {length} * {SNAP_M}D AND along > {SNAP_M}D AND along < {length} - {SNAP_M}D"
    cuts = near.where(on_it).distinct()
    cut = stage(cuts, "outline-cuts")
    whole = edges.join(cut.select("outline", *ENDS).distinct(), ["outline", *ENDS], "left_anti")
    starts = cut.selectExpr("outline", *ENDS, "0D AS along", "x1 AS px", "y1 AS py").distinct()
    order = f"OVER (PARTITION BY outline, {', '.join(ENDS)} ORDER BY along, px, py)"
    pieces = cut.unionByName(starts).selectExpr(
        "outline", "px AS a", "py AS b", f"coalesce(lead(px) {order}, x2) AS c", f"coalesce(lead(py) {order}, y2) AS d"
    )
    pieces = pieces.toDF("outline", *ENDS).where("x1 <> x2 OR y1 <> y2")
    found = whole.unionByName(northward(pieces))
    times = found.groupBy(*ENDS).agg((F.count("*") % 2 == 0).alias("shared"))
    found = stage(found.join(times, ENDS), "outline-lines")
    for table in [*used, cut]:
        discard(table)
    return found


def _top_level(edges: DataFrame, placed: DataFrame, side: float, used: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The placed edges with ``inside`` of their cell's south-east corner, and cells wholly inside an outline.

    Along the south side of a row of cells, an edge that crosses it changes sides for all corners west of it.
    """
    long = number(side)
    rows = f"explode(sequence({index_of('y1', long, 1)}, {index_of('y2', long, 1)} + 1)) AS cy"
    crossed = edges.selectExpr("*", rows).selectExpr("*", f"{line('cy', long, 1)} AS y").where("y1 <= y AND y < y2")
    crossed = crossed.selectExpr("*", f"{index_of('x1 + (x2 - x1) * ((y - y1) / (y2 - y1))', long, 0)} AS at")
    # the last column whose corner lies west of the edge, by the test that points use
    tries = " ".join(f"WHEN {turn('', line(f'at + {k} + 1', long, 0), 'y')} > 0 THEN at + {k}" for k in (1, 0, -1))
    last = F.expr(f"CASE {tries} ELSE at - 2 END")
    crossings = crossed.groupBy("outline", "cy", last.alias("cx")).agg(F.count("*").alias("n"))
    border = placed.groupBy("outline", "cy", "cx").agg(F.lit(0).cast("long").alias("n"))
    items = (
        crossings.withColumn("border", F.lit(False))
        .unionByName(border.withColumn("border", F.lit(True)))
        .groupBy("outline", "cy", "cx")
        .agg(F.sum("n").alias("n"), F.max("border").alias("border"))
    )
    westward = "OVER (PARTITION BY outline, cy ORDER BY cx DESC)"
    known = items.selectExpr("outline", "cx", "cy", "border", f"sum(n) {westward} % 2 = 1 AS inside")
    known = known.selectExpr("*", f"lag(cx) {westward} AS next", f"lag(inside) {westward} AS gap_inside")
    known = stage(known, "outline-corners")
    used.append(known)
    gaps = known.where("gap_inside AND next > cx + 1").select(F.explode(F.sequence(F.col("cx") + 1, F.col("next") - 1)).alias("cx"), "cy")
    whole = gaps.unionByName(known.where("inside AND NOT border").select("cx", "cy"))
    return placed.join(known.where("border").select("outline", "cx", "cy", "inside"), ["outline", "cx", "cy"]), whole.distinct()


def _next_level(placed: DataFrame, side: float, used: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The same for the parts, of side ``side``, of crowded cells, from the corners of these."""
    parts = _parts(placed, side)
    outer, own = number(side * FACTOR), number(side)
    east, south = line("cx + 1", outer, 0), line("cy", outer, 1)
    x, y = line("kx + 1", own, 0), line("ky", own, 1)
    changes = F.expr(f"IF({crosses_west('', x, y, east)} <> {crosses_north('', east, south, y)}, 1, 0)")
    corners = parts.groupBy("outline", "kx", "ky", F.col("inside").alias("outer")).agg(
        F.sum(changes).alias("n"), F.max("meets").alias("border")
    )
    corners = corners.select("outline", "kx", "ky", "border", (F.col("outer") != (F.col("n") % 2 == 1)).alias("own"))
    corners = stage(corners, "outline-corners")
    used.append(corners)
    met = parts.where("meets").join(corners.where("border"), ["outline", "kx", "ky"])
    found = met.select("outline", *ENDS, "shared", F.col("own").alias("inside"), F.col("kx").alias("cx"), F.col("ky").alias("cy"))
    return found, corners.where("own AND NOT border").select(F.col("kx").alias("cx"), F.col("ky").alias("cy")).distinct()


def cover(edges: DataFrame, unit: float) -> tuple[DataFrame, list[float], DataFrame | None]:
    """Cells of noded outlines, the side of the cells of each level, and the edges of cells that stay crowded.

    Cells: ``level, cx, cy, outlines``; without outlines all of the cell is inside.
    Otherwise ``outlines`` has for each outline that touches the cell whether its south-east corner is
    ``inside`` and its ``edges``, ``shared`` if an even number of outlines has them.
    The third value, None if there are none, has a row for each edge of a cell that
    ``DEPTH`` splits left with more than ``MAX_EDGES``: so many edges meet in one place.
    """
    lines = northward(edges)
    side = top_side(lines, unit)
    lines = noded(lines, side)
    sides, leaves, rest, used = [side], [], None, [lines]
    placed, whole = _top_level(lines, _placed(lines, side), side, used)
    for level in range(DEPTH + 1):
        placed = stage(_with_size(placed.join(whole, ["cx", "cy"], "left_anti")), "outline-edges")
        used.append(placed)
        few, many = placed.where(F.col("n") <= MAX_EDGES), placed.where(F.col("n") > MAX_EDGES)
        border = few.groupBy("cx", "cy", "outline", "inside").agg(F.collect_list(F.struct(*ENDS, "shared")).alias("edges"))
        border = border.groupBy("cx", "cy").agg(F.collect_list(F.struct("inside", "edges")).alias("outlines"))
        at_level = whole.unionByName(border, allowMissingColumns=True)
        leaves.append(at_level.withColumn("level", F.lit(level)))
        if many.isEmpty():
            break
        if level == DEPTH:
            rest = stage(many.withColumn("level", F.lit(level)).drop("n"), "outline-crowded")
            break
        side /= FACTOR
        sides.append(side)
        placed, whole = _next_level(many, side, used)
    found = stage(reduce(DataFrame.unionByName, leaves), "outline-cells")
    for table in used:
        discard(table)
    return found, sides, rest
