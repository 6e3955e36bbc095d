"""Skin texture and corneal reflections from luminance grids, with array functions only: a projection, no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDE = 8
#: Luminances up to so far apart are alike, cells with so large a share (in tenths) of the brightest are a highlight, and a shift of the highlight
#: by so many cells is a full score.
ALIKE, BRIGHT, FULL_SHIFT = 8, 9, 3.5
#: The neighbours of a cell in turn.
RING = ((-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1))


def _inner(side: int) -> Column:
    """The numbers of the cells that have eight neighbours."""
    return F.array(*[F.lit(r * side + c) for r in range(1, side - 1) for c in range(1, side - 1)])


def skin_texture(df: DataFrame, grid: str, side: int = SIDE) -> DataFrame:
    """Adds what tells grown from generated skin in a grid of side x side luminances:

    contrast, the mean squared difference of horizontal neighbours; homogeneity, the share of neighbours that are alike; uniform_share, the share
    of inner cells whose local binary pattern (which of the eight neighbours are no darker) changes twice at most around the cell; and patterns,
    how many kinds of pattern there are (uniform ones by their number of bits, all others one kind). Null for grids of another size.
    """
    g = F.col(grid)
    fits = F.size(g) == side * side
    at = lambda i: F.get(g, i)
    pairs = F.array(*[F.lit(r * side + c) for r in range(side) for c in range(side - 1)])
    n = side * (side - 1)
    apart = F.transform(pairs, lambda i: at(i) - at(i + 1))
    contrast = F.aggregate(apart, F.lit(0).cast("bigint"), lambda a, x: a + (x * x).cast("bigint")) / F.lit(float(n))
    alike = F.size(F.filter(apart, lambda x: F.abs(x) <= ALIKE)) / F.lit(float(n))

    def pattern(i: Column) -> Column:
        bits = [F.when(at(i + dr * side + dc) >= at(i), 1).otherwise(0) for dr, dc in RING]
        turns = sum((F.when(bits[k] != bits[(k + 1) % 8], 1).otherwise(0) for k in range(8)), F.lit(0))
        return F.when(turns <= 2, sum(bits, F.lit(0))).otherwise(9)

    kinds = F.transform(_inner(side), pattern)
    df = df.withColumn("_kinds", F.when(fits, kinds))
    uniform = F.size(F.filter("_kinds", lambda k: k < 9)) / F.lit(float((side - 2) ** 2))
    cols = {"contrast": F.when(fits, contrast), "homogeneity": F.when(fits, alike), "uniform_share": F.when(fits, uniform), "patterns": F.when(fits, F.size(F.array_distinct("_kinds")).cast("bigint"))}
    return df.withColumns(cols).drop("_kinds")


def _highlight(grid: str, side: int) -> tuple[Column, Column, Column]:
    """Cells of the highlight, and the mean column and row of them."""
    g = F.col(grid)
    top = F.array_max(g)
    cells = F.filter(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: F.get(g, i) * 10 >= top * BRIGHT)
    n = F.size(cells)
    mean = lambda of: F.aggregate(cells, F.lit(0).cast("bigint"), lambda a, i: a + of(i).cast("bigint")) / n.cast("double")
    return n.cast("bigint"), mean(lambda i: i % side), mean(lambda i: F.floor(i / side))


def corneal_reflections(df: DataFrame, left: str, right: str, side: int = SIDE) -> DataFrame:
    """Adds left_cells and right_cells, the sizes of the highlights in the two eyes' grids, shift, the distance of their centres in cells, and
    corneal_score, from 0 where they lie alike to 1. Null where a grid is null or of another size."""
    fits = F.coalesce((F.size(left) == side * side) & (F.size(right) == side * side), F.lit(False))
    (ln, lx, ly), (rn, rx, ry) = _highlight(left, side), _highlight(right, side)
    df = df.withColumns({"left_cells": F.when(fits, ln), "right_cells": F.when(fits, rn), "_dx": F.when(fits, F.abs(lx - rx)), "_dy": F.when(fits, F.abs(ly - ry))})
    df = df.withColumn("shift", F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))).drop("_dx", "_dy")
    return df.withColumn("corneal_score", F.when(F.col("shift").isNotNull(), F.least(F.lit(1.0), F.col("shift") / FULL_SHIFT)))
