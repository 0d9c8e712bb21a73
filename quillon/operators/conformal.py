"""Class-conditional conformal thresholds and the decisions that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.plans.prefix import running


def fit(df: DataFrame, alpha: float = 0.1, y: str = "y", score: str = "score") -> DataFrame:
    """(q_pos, q_neg): the ceil((n + 1)(1 - alpha))-th smallest nonconformity of each class, infinite beyond n.

    Raises if a class has no rows.
    """
    parts = []
    for label, name in ((1, "q_pos"), (0, "q_neg")):
        c = df.where(F.col(y) == label).select((1.0 - F.col(score) if label else F.col(score)).alias("a"))
        n = c.agg(F.count("*").alias("n"))
        g = running(c.groupBy("a").agg(F.count("*").alias("m")), "a", {"upto": F.col("m")}).crossJoin(F.broadcast(n))
        rank = F.ceil((F.col("n") + 1) * F.lit(1.0 - alpha))
        q = g.where(F.col("upto") >= rank).agg(F.min("a").alias("q")).crossJoin(F.broadcast(n))
        parts.append(q.select(F.when(F.col("n") == 0, F.raise_error(F.lit(f"no calibration rows with y = {label}")).cast("double")).otherwise(F.coalesce("q", F.lit(float("inf")))).alias(name)))
    return parts[0].crossJoin(parts[1])


def prediction_sets(df: DataFrame, q: DataFrame, score: str = "score") -> DataFrame:
    """df with its labels (1, 0, both or none) and whether they are ambiguous, which is any number but one."""
    x = df.crossJoin(F.broadcast(q))
    labels = F.array_compact(F.array(F.when(1.0 - F.col(score) <= F.col("q_pos"), 1), F.when(F.col(score) <= F.col("q_neg"), 0)))
    return x.withColumn("labels", labels).withColumn("ambiguous", F.size("labels") != 1).drop("q_pos", "q_neg")


def override(decision: Column, ambiguous: Column) -> Column:
    """Ambiguous cases are deferred."""
    return F.when((decision != "defer_to_human") & ambiguous, "defer_to_human").otherwise(decision)
