"""Exact order statistics without a sort: ranges are counted again and again, and only the one that holds the rank is kept."""

from __future__ import annotations

from dataclasses import dataclass
from math import inf, nextafter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cuts that a range is parted by, and values that are fetched when so few are left.
CUTS, FEW = 64, 256


@dataclass
class Range:
    """Values above low (all, if None) and up to high (all, if None) of a column; rank is counted from 0 inside."""

    column: str
    low: float | None
    high: float | None
    rank: int
    n: int

    def holds(self) -> Column:
        c = F.col(self.column)
        at = c.isNotNull() & ~F.isnan(c)
        if self.low is not None:
            at &= c > F.lit(self.low)
        return at & (c <= F.lit(self.high)) if self.high is not None else at


def order_statistics(df: DataFrame, ranks: dict[str, list[int]]) -> dict[tuple[str, int], float]:
    """{(column, rank): value}: the rank-th smallest value (from 0) of each numeric column, nulls left out and nan last.

    Each round reads the columns of the ranges that are still open twice: for approximate quantiles of a range, whose state
    is bounded, and for the counts between them. The driver holds CUTS numbers a range, and in the end FEW values.
    """
    df = df.select(*(F.col(c).cast("double").alias(c) for c in ranks))
    sizes = df.agg(*(F.count(F.nanvl(c, F.lit(None))).alias(c) for c in ranks), *(F.count(c).alias(f"all {c}") for c in ranks)).first()
    found = {(c, k): float("nan") for c, ks in ranks.items() for k in ks if sizes[c] <= k < sizes[f"all {c}"]}
    open_ = {(c, k): Range(c, None, None, k, sizes[c]) for c, ks in ranks.items() for k in ks if 0 <= k < sizes[c]}
    while open_:
        # ranks of one range are looked for together
        at: dict[tuple, list[tuple[str, int]]] = {}
        for key, r in open_.items():
            at.setdefault((r.column, r.low, r.high), []).append(key)
        ranges = [open_[keys[0]] for keys in at.values()]
        fractions = [k / CUTS for k in range(1, CUTS)]
        own = [F.when(r.holds(), F.col(r.column)) for r in ranges]
        seen = df.agg(*(F.struct(F.percentile_approx(x, fractions, 10_000).alias("cuts"), F.min(x).alias("a"), F.max(x).alias("b")).alias(f"r{k}") for k, x in enumerate(own))).first()
        for k, (r, keys) in enumerate(zip(ranges, at.values(), strict=True)):
            low, high = seen[k]["a"], seen[k]["b"]
            if r.n <= FEW or low == high:
                values = [low] if low == high else [x[0] for x in df.where(r.holds()).select(r.column).orderBy(r.column).limit(FEW).collect()]
                found |= {key: values[min(open_.pop(key).rank, len(values) - 1)] for key in keys}
                continue
            # the least and the largest value are parts of their own, so each round takes both away however often they occur
            cuts = sorted({low, nextafter(high, -inf), *(x for x in seen[k]["cuts"] if x < high)})
            part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x < F.col(r.column)))  # noqa: B023
            counts = dict(df.where(r.holds()).groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
            for key in keys:
                rank = open_.pop(key).rank
                for p in sorted(counts):
                    if rank < counts[p]:
                        break
                    rank -= counts[p]
                if p in (0, len(cuts)):
                    found[key] = high if p else low
                else:
                    open_[key] = Range(r.column, cuts[p - 1], cuts[p], rank, counts[p])
    return found


def quantiles(df: DataFrame, fractions: dict[str, list[float]]) -> dict[tuple[str, float], float | None]:
    """{(column, fraction): value}, interpolated between the two neighbours of (n - 1) * fraction; None without values."""
    sizes = df.agg(*(F.count(c).alias(c) for c in fractions)).first()
    places = {(c, f): (sizes[c] - 1) * f for c, fs in fractions.items() for f in fs if sizes[c]}
    ranks: dict[str, set[int]] = {}
    for (c, _), h in places.items():
        ranks.setdefault(c, set()).update({int(h), min(int(h) + 1, sizes[c] - 1)})
    values = order_statistics(df, {c: sorted(ks) for c, ks in ranks.items()}) if ranks else {}
    out: dict[tuple[str, float], float | None] = {(c, f): None for c, fs in fractions.items() for f in fs}
    for (c, f), h in places.items():
        k, part = int(h), h - int(h)
        low, high = values[c, k], values[c, min(k + 1, sizes[c] - 1)]
        out[c, f] = low if part == 0 or low == high else (1 - part) * low + part * high
    return out
