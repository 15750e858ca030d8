"""Positions on a square grid of sub-vectors, and box arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def grid_row(cell: str | Column, grid: int) -> Column:
    return F.floor(_c(cell) / F.lit(grid)).cast("int")


def grid_col(cell: str | Column, grid: int) -> Column:
    return (_c(cell) % F.lit(grid)).cast("int")


def centre_distance(cell: str | Column, grid: int) -> Column:
    """Euclidean distance, in cells, to the cell ``(grid // 2, grid // 2)``."""
    mid = F.lit(grid // 2)
    dr, dc = grid_row(cell, grid) - mid, grid_col(cell, grid) - mid
    return F.sqrt((dr * dr + dc * dc).cast("double"))


def centrality(cell: str | Column, grid: int) -> Column:
    """1 at the centre of the grid, falling with the distance."""
    return F.lit(1.0) / (F.lit(1.0) + centre_distance(cell, grid) / F.lit(10.0))


def padded_box(left: Column, top: Column, right: Column, bottom: Column,
               width: Column, height: Column, pad: float = 0.05) -> Column:
    """Box grown by a share of its own size on each side, clamped to the frame."""
    px = F.floor((right - left) * F.lit(pad))
    py = F.floor((bottom - top) * F.lit(pad))
    zero = F.lit(0).cast("long")
    return F.struct(
        F.greatest(zero, left - px).alias("l"), F.greatest(zero, top - py).alias("t"),
        F.least(width, right + px).alias("r"), F.least(height, bottom + py).alias("b"))


def _axis(lo: Column, hi: Column, side: Column, limit: Column) -> tuple[Column, Column]:
    half = F.floor(side / F.lit(2))
    start = F.greatest(F.lit(0).cast("long"), F.floor((lo + hi) / F.lit(2)) - half)
    end = F.least(limit, start + side)
    back = F.greatest(F.lit(0).cast("long"), end - side)
    clipped = (end - start) < side
    start2 = F.when(clipped, back).otherwise(start)
    return start2, F.when(clipped, F.least(limit, start2 + side)).otherwise(end)


def square_box(row_lo: Column, row_hi: Column, col_lo: Column, col_hi: Column,
               width: Column, height: Column, patch: int, margin: float = 1.08) -> Column:
    """Square pixel box around occupied grid cells.

    Cell bounds are inclusive and are turned into pixels exactly once. The side
    is the longer extent times ``margin``; a box cut by the frame is shifted back
    inside it. NULL bounds (nothing occupied) give the centred square.
    """
    x0, x1 = col_lo * patch, (col_hi + 1) * patch
    y0, y1 = row_lo * patch, (row_hi + 1) * patch
    shortest = F.least(width, height)
    side = F.coalesce(F.floor(F.greatest(x1 - x0, y1 - y0) * F.lit(margin)), shortest)
    l, r = _axis(F.coalesce(x0, F.lit(0)), F.coalesce(x1, width), side, width)
    t, b = _axis(F.coalesce(y0, F.lit(0)), F.coalesce(y1, height), side, height)
    return F.struct(l.alias("l"), t.alias("t"), r.alias("r"), b.alias("b"))
