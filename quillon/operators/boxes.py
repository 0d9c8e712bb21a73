"""Spatial joins of boxes on a grid of many sizes: a box meets those near it, not all of its case."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGES = ("x0", "y0", "x1", "y1")
#: Boxes smaller than a cell of 2**FINEST lie in cells of that size.
FINEST = -20


def _level(low: tuple[Column, Column], high: tuple[Column, Column]) -> Column:
    """The smallest cell, as a power of 2, that is as large as the box: it touches two of them in each direction at most."""
    size = F.greatest(high[0] - low[0], high[1] - low[1])
    return F.when(size > 2.0**FINEST, F.ceil(F.log2(size)).cast("int")).otherwise(FINEST)


def _placed(boxes: DataFrame, name: str) -> DataFrame:
    """boxes as a struct column name, with corners in order (a0, b0, a1, b1) and their level. Boxes with null or non-finite edges are left out."""
    x0, y0, x1, y1 = (F.col(c).cast("double") for c in EDGES)
    finite = reduce(lambda a, b: a & b, (F.coalesce(F.abs(c) < float("inf"), F.lit(False)) for c in (x0, y0, x1, y1)))
    a0, b0, a1, b1 = F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1)
    return boxes.where(finite).select(F.struct(*boxes.columns).alias(name), a0.alias("a0"), b0.alias("b0"), a1.alias("a1"), b1.alias("b1"), _level((a0, b0), (a1, b1)).alias("own"))


def _dealt(placed: DataFrame, levels: list[int]) -> DataFrame:
    """A row for each cell that a box touches, on its own level and on those of the larger boxes of the other side."""
    on = placed.withColumn("level", F.explode(F.array_union(F.array("own"), F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda k: k > F.col("own")))))
    size = F.pow(F.lit(2.0), F.col("level"))
    cell = lambda c: F.floor(F.col(c) / size)
    on = on.withColumn("i", F.explode(F.sequence(cell("a0"), cell("a1"))))
    return on.withColumn("j", F.explode(F.sequence(cell("b0"), cell("b1"))))


def touching(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """(l, r): structs of all pairs of a left and a right box, equal in by, that have a point in common, borders included.

    Both sides have the columns EDGES; corners may come in any order. A box is dealt to the cells, of about its own size,
    that it touches, and to those of each size that the other side's larger boxes use: four cells a size at most, and sizes are
    powers of 2. Two boxes meet on the level of the larger one; the cell that holds the low corner of what they share counts the pair.
    Repeated boxes are as many pairs, so group equal ones first. Nulls in by or in an edge have no partner.
    """
    a, b = _placed(left, "l"), _placed(right, "r")
    # sizes are powers of 2 of finite numbers, so there are few, however many boxes there are
    sizes = lambda x: sorted(row[0] for row in x.select("own").distinct().collect())
    x, y = _dealt(a, sizes(b)).alias("x"), _dealt(b, sizes(a)).alias("y")
    same = reduce(lambda p, q: p & q, (F.col(f"x.l.{k}") == F.col(f"y.r.{k}") for k in by), F.lit(True))
    for k in ("level", "i", "j"):
        same &= F.col(f"x.{k}") == F.col(f"y.{k}")
    met = (F.col("x.own") == F.col("x.level")) | (F.col("y.own") == F.col("y.level"))
    size = F.pow(F.lit(2.0), F.col("x.level"))
    low = {k: F.greatest(f"x.{k}0", f"y.{k}0") for k in "ab"}
    shared = (low["a"] <= F.least("x.a1", "y.a1")) & (low["b"] <= F.least("x.b1", "y.b1"))
    counted = (F.floor(low["a"] / size) == F.col("x.i")) & (F.floor(low["b"] / size) == F.col("x.j"))
    return x.join(y, same & met & shared & counted).select("l", "r")
