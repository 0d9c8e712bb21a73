"""Running sums over a whole table without bringing it to one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that the order is cut into: the only rows that ever meet in one task besides those of a range.
RANGES = 64


def ranged(df: DataFrame, order: str, ranges: int = RANGES) -> DataFrame:
    """df with a column _range, ascending with order: equal values share a range, and ranges hold about as many rows.

    The bounds are approximate quantiles, at most ranges - 1 numbers; nulls lie in range 0.
    """
    bounds = df.agg(F.percentile_approx(F.col(order).cast("double"), [k / ranges for k in range(1, ranges)], 1000).alias("b")).first()[0] or []
    bounds = sorted(set(bounds))
    return df.withColumn("_range", F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda b: b <= F.col(order).cast("double"))))


def running(df: DataFrame, order: str, sums: dict[str, Column], descending: bool = False, tie: list[Column] | None = None, ranges: int = RANGES) -> DataFrame:
    """df with a column for each of sums: the sum over all rows up to and with the row, in the given order.

    Rows that tie in order (and tie) get sums in any order among them; group first where that matters.
    """
    df = ranged(df, order, ranges)
    by = [F.col(order).desc() if descending else F.col(order).asc(), *(tie or [])]
    inside = Window.partitionBy("_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    local = df.select("*", *(F.sum(x).over(inside).alias(name) for name, x in sums.items()))
    totals = df.groupBy("_range").agg(*(F.sum(x).alias(f"_t{name}") for name, x in sums.items()))
    # at most `ranges` rows, so one task and a broadcast are fine
    before = Window.orderBy(F.col("_range").desc() if descending else F.col("_range").asc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", *(F.coalesce(F.sum(f"_t{name}").over(before), F.lit(0)).alias(f"_o{name}") for name in sums))
    joined = local.join(F.broadcast(offsets), "_range")
    return joined.select(*df.columns[:-1], *((F.col(name) + F.col(f"_o{name}")).alias(name) for name in sums))


def numbered(df: DataFrame, order: str, tie: list[Column] | None = None, name: str = "rn", ranges: int = RANGES) -> DataFrame:
    """df with row numbers from 1 over the whole table, in order of a numeric column, then tie."""
    return running(df, order, {name: F.lit(1).cast("bigint")}, tie=tie, ranges=ranges)


def running_by(df: DataFrame, by: list[str], order: str, sums: dict[str, Column], ranges: int = RANGES) -> DataFrame:
    """df with running sums inside each group of by. Groups are cut into the same ranges, so a large one isn't one task.

    Rows that tie in order get sums in any order among them; null groups are groups.
    """
    df = ranged(df, order, ranges)
    key = [*by, "_range"]
    inside = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    # at most `ranges` rows of each group
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    local = df.select("*", *(F.sum(x).over(inside).alias(name) for name, x in sums.items())).alias("l")
    totals = df.groupBy(*key).agg(*(F.sum(x).alias(name) for name, x in sums.items()))
    offsets = totals.select(*key, *(F.coalesce(F.sum(name).over(before), F.lit(0)).alias(name) for name in sums)).alias("o")
    same = reduce(lambda a, b: a & b, (F.col(f"l.{k}").eqNullSafe(F.col(f"o.{k}")) for k in key))
    return local.join(offsets, same).select(*(f"l.{c}" for c in df.columns[:-1]), *((F.col(f"l.{name}") + F.col(f"o.{name}")).alias(name) for name in sums))
