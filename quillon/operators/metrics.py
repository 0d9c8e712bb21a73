"""Rank and calibration metrics. Scores are grouped first, so sorts and running sums see each value once.

All take a table with a label y (1 positive, 0 negative) and a score, and give a table of one row. One-class
tables give null where the metric needs both classes, unless stated otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.selection import quantiles
from quillon.plans.prefix import numbered, running, running_by


def by_score(df: DataFrame, y: str = "y", score: str = "score", weight: Column | None = None) -> DataFrame:
    """(s, p, n): positives and negatives of each score."""
    w = F.lit(1).cast("bigint") if weight is None else weight
    return df.groupBy(F.col(score).alias("s")).agg(F.sum(F.when(F.col(y) == 1, w).otherwise(0)).alias("p"), F.sum(F.when(F.col(y) == 0, w).otherwise(0)).alias("n"))


def auroc(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """The share of (positive, negative) pairs in the right order, ties counting half; null for one class."""
    g = running(by_score(df, y, score), "s", {"upto": F.col("n")})
    twice = F.sum((F.col("p") * (2 * F.col("upto") - F.col("n"))).cast("decimal(38,0)"))
    return g.agg(twice.alias("t"), F.sum("p").alias("p"), F.sum("n").alias("n")).select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("t").cast("double") / (2.0 * F.col("p") * F.col("n"))).alias("auroc"))


def auroc_by(df: DataFrame, by: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """AUROC of each group."""
    g = df.groupBy(*by, F.col(score).alias("s")).agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("n"))
    g = running_by(g, by, "s", {"upto": F.col("n")})
    g = g.groupBy(*by).agg(F.sum((F.col("p") * (2 * F.col("upto") - F.col("n"))).cast("decimal(38,0)")).alias("t"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return g.select(*by, F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("t").cast("double") / (2.0 * F.col("p") * F.col("n"))).alias("auroc"), (F.col("p") + F.col("n")).alias("n_cases"))


def sensitivity_by(df: DataFrame, by: list[str], specificity: float = 0.96, y: str = "y", score: str = "score") -> DataFrame:
    """(by, p, n, sensitivity) of each group: its positives above its own threshold at that specificity; null without both classes."""
    each = df.groupBy(*by, F.col(score).alias("s")).agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("n"))
    # the first score whose negatives reach the k-th is the threshold; positives up to it are missed
    g = running_by(each, by, "s", {"upto": F.col("n"), "missed": F.col("p")}).alias("g")
    z = each.groupBy(*by).agg(F.sum("p").alias("pp"), F.sum("n").alias("nn")).alias("z")
    same = reduce(lambda x, y: x & y, (F.col(f"g.{k}").eqNullSafe(F.col(f"z.{k}")) for k in by))
    k = F.least(F.greatest(F.ceil(F.lit(float(specificity)) * F.col("nn")), F.lit(1)), F.col("nn"))
    cut = F.min(F.when((F.col("n") > 0) & (F.col("upto") >= k), F.struct("s", "missed")))
    out = g.join(z, same).groupBy(*(F.col(f"z.{x}") for x in by)).agg(F.first("pp").alias("p"), F.first("nn").alias("n"), cut.alias("cut"))
    return out.select(*by, "p", "n", F.when((F.col("p") > 0) & (F.col("n") > 0), (F.col("p") - F.col("cut.missed")) / F.col("p")).alias("sensitivity"))


def ablation(arms: DataFrame, specificity: float = 0.96, costs: tuple[str, ...] = ("tool_calls", "wall_ms", "usd")) -> DataFrame:
    """(arm, auroc, sensitivity, n_cases, mean of each cost) of arms(arm, y, score, costs); a cost that is null counts as 0."""
    means = arms.groupBy("arm").agg(*(F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"mean_{c}") for c in costs))
    return auroc_by(arms, ["arm"]).join(sensitivity_by(arms, ["arm"], specificity).select("arm", "sensitivity"), "arm").join(means, "arm")


def threshold_at_specificity(df: DataFrame, specificity: float = 0.96, y: str = "y", score: str = "score") -> DataFrame:
    """The k-th smallest negative score, k = ceil(specificity * negatives), at least 1: an order statistic."""
    g = running(by_score(df.where(F.col(y) == 0), y, score), "s", {"upto": F.col("n")})
    n = g.agg(F.sum("n").alias("all"))
    k = F.least(F.greatest(F.ceil(F.lit(float(specificity)) * F.col("all")), F.lit(1)), F.col("all"))
    return g.crossJoin(F.broadcast(n)).where(F.col("upto") >= k).agg(F.min("s").alias("threshold"))


def sensitivity_at_specificity(df: DataFrame, specificity: float = 0.96, y: str = "y", score: str = "score") -> DataFrame:
    """The share of positives strictly above that threshold."""
    t = threshold_at_specificity(df, specificity, y, score)
    return df.where(F.col(y) == 1).crossJoin(F.broadcast(t)).agg(F.avg(F.when(F.col(score) > F.col("threshold"), 1.0).when(F.col("threshold").isNotNull(), 0.0)).alias("sensitivity"))


def partial_auc(df: DataFrame, min_specificity: float = 0.9, normalize: bool = True, y: str = "y", score: str = "score") -> DataFrame:
    """Area under the ROC curve up to a false positive rate of 1 - min_specificity, by trapezoids cut at it.

    Class sizes count as 1 at least, so one class gives a number.
    """
    g = running(by_score(df, y, score), "s", {"cp": F.col("p"), "cn": F.col("n")}, descending=True)
    t = g.agg(F.greatest(F.sum("p"), F.lit(1)).alias("tp"), F.greatest(F.sum("n"), F.lit(1)).alias("tn"))
    cap = 1.0 - min_specificity
    g = g.crossJoin(F.broadcast(t)).select(
        ((F.col("cn") - F.col("n")) * 1.0 / F.col("tn")).alias("x0"), ((F.col("cp") - F.col("p")) * 1.0 / F.col("tp")).alias("y0"),
        (F.col("cn") * 1.0 / F.col("tn")).alias("x1"), (F.col("cp") * 1.0 / F.col("tp")).alias("y1"),
    )
    xc = F.least(F.col("x1"), F.lit(cap))
    slope = (F.col("y1") - F.col("y0")) * ((xc - F.col("x0")) / (F.col("x1") - F.col("x0")))
    part = F.when((F.col("x0") < cap) & (xc > F.col("x0")), (xc - F.col("x0")) * (F.col("y0") + F.col("y0") + slope) / 2.0).otherwise(0.0)
    return g.agg((F.sum(part) / (cap if normalize else 1.0)).alias("partial_auc"))


def brier(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    d = F.col(score) - F.col(y)
    return df.agg(F.avg(d * d).alias("brier"))


def ece_adaptive(df: DataFrame, bins: int = 10, y: str = "y", score: str = "score", tie: str = "case_id") -> DataFrame:
    """Expected calibration error over bins of equal mass, ordered by score, then tie; empty bins don't count."""
    n = df.count()
    low, more = divmod(n, bins)
    edge = more * (low + 1)
    k = F.col("rn") - 1
    tile = F.when(k < edge, F.floor(k / (low + 1))).otherwise(more + F.floor((k - edge) / max(low, 1)))
    b = numbered(df, score, [F.col(tie).asc()]).withColumn("_b", tile)
    g = b.groupBy("_b").agg(F.count("*").alias("m"), F.abs(F.avg(score) - F.avg(y)).alias("gap"))
    return g.agg((F.sum(F.col("m") * F.col("gap")) / F.sum("m")).alias("ece"))


def negative_flips(df: DataFrame, specificity: float = 0.96, y: str = "y", cand: str = "cand", champ: str = "champ") -> DataFrame:
    """Positives that the champion catches and the candidate misses, at thresholds that are interpolated quantiles of each arm's negatives.

    The thresholds are exact, by repeated counts of ranges; without negatives there are none and nothing counts.
    """
    found = quantiles(df.where(F.col(y) == 0), {cand: [specificity], champ: [specificity]})
    t_cand, t_champ = (F.lit(found[c, specificity]).cast("double") for c in (cand, champ))
    right = F.col(champ) > t_champ
    x = df.where(F.col(y) == 1).agg(F.count_if(right & (F.col(cand) <= t_cand)).alias("flips"), F.count_if(right).alias("champion_correct"))
    return x.select("flips", "champion_correct", (F.col("flips") * 1.0 / F.greatest("champion_correct", F.lit(1))).alias("flip_rate"))


def agreement(df: DataFrame, score: str = "cand", rerun: str = "rerun") -> DataFrame:
    """The share of cases whose second run gave about the same score; the second run sets the tolerance."""
    from quillon.functions.expr import isclose

    return df.agg(F.avg(F.when(isclose(F.col(score), F.col(rerun)), 1.0).otherwise(0.0)).alias("agreement"))


def efficiency(df: DataFrame, sensitivity: DataFrame, calls: str = "tool_calls", usd: str = "usd", wall_ms: str = "wall_ms") -> DataFrame:
    """Sensitivity per 1,000 tool calls, per dollar and per minute; null where nothing was spent."""
    t = df.agg(F.sum(calls).alias("c"), F.sum(usd).alias("u"), F.sum(wall_ms).alias("w")).crossJoin(F.broadcast(sensitivity))
    per = lambda d: F.when(d > 0, F.col("sensitivity") / d)
    return t.select("sensitivity", per(F.col("c") / 1000.0).alias("per_1k_calls"), per(F.col("u")).alias("per_usd"), per(F.col("w") / 60000.0).alias("per_minute"))


def worst_slice(df: DataFrame, attributes: list[str], specificity: float = 0.96, min_n: int = 1, y: str = "y", score: str = "score") -> DataFrame:
    """Sensitivity of every level of every attribute with min_n cases and both classes: (slice, n, sensitivity)."""
    long = df.select(F.col(y).alias("y"), F.col(score).alias("s"), F.explode(F.array(*(F.concat(F.lit(f"{a}="), F.col(a).cast("string")) for a in attributes))).alias("slice"))
    g = sensitivity_by(long.where("slice is not null"), ["slice"], specificity, score="s")
    return g.where(F.col("sensitivity").isNotNull() & (F.col("p") + F.col("n") >= min_n)).select("slice", (F.col("p") + F.col("n")).alias("n"), "sensitivity")
