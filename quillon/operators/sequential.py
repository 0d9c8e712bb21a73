"""Anytime-valid non-inferiority by betting: a wealth process over patient clusters, and checks around it."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def payoffs(cases: DataFrame, margin: float, y: str = "y", cand: str = "cand", champ: str = "champ", pid: str = "pid", order: str = "seq", batch: str | None = None) -> DataFrame:
    """(pid, batch, first, x): the mean paired difference of each cluster's positives plus the margin, at its first place."""
    g = cases.where(F.col(y) == 1).groupBy(F.col(pid).alias("pid"), *([F.col(batch).alias("batch")] if batch else []))
    return g.agg((F.avg(F.col(cand).cast("double") - F.col(champ).cast("double")) + F.lit(margin)).alias("x"), F.min(order).alias("first"))


def paired(cand: DataFrame, champ: DataFrame, key: str = "case_id", score: str = "score", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep, cand, champ): the scores of both arms, case by case; keep are columns of the candidate's arm.

    Every case must be there once in either arm; a case that is not fails the job, as do null keys. The arms meet in one
    grouping, so a key that repeats costs a count and no pairs.
    """
    arm = lambda df, mine: df.select(F.col(key).alias("_k"), F.struct(F.lit(mine).alias("mine"), F.col(score).alias("s"), *(F.col(c) if mine else F.lit(None).alias(c) for c in keep)).alias("_r"))
    rows = arm(cand, True).select("_k", F.col("_r").alias("a"), F.lit(None).alias("b")).unionByName(arm(champ, False).select("_k", F.lit(None).alias("a"), F.struct("_r.s").alias("b")))
    g = rows.groupBy("_k").agg(F.count("a").alias("_a"), F.count("b").alias("_b"), F.first("a", ignorenulls=True).alias("a"), F.first("b", ignorenulls=True).alias("b"))
    once = F.col("_k").isNotNull() & (F.col("_a") == 1) & (F.col("_b") == 1)
    said = F.concat(F.lit("a case must be once in each arm: "), F.coalesce(F.col("_k").cast("string"), F.lit("null")))
    g = g.where(F.when(once, True).otherwise(F.raise_error(said).cast("boolean")))
    return g.select(F.col("_k").alias(key), *(F.col(f"a.{c}").alias(c) for c in keep), F.col("a.s").alias("cand"), F.col("b.s").alias("champ"))


def repeated_clusters(payoff: DataFrame) -> DataFrame:
    """Clusters bet on in more than one batch, which the test refuses."""
    return payoff.groupBy("pid").agg(F.count_distinct("batch").alias("batches")).where("batches > 1")


def wealth(payoff: DataFrame, margin: float = 0.02, alpha: float = 0.05, batch_size: int | None = None) -> DataFrame:
    """(batch, i, x, lam, log_wealth) for payoffs in order of first.

    The bet of a batch is set by strictly earlier batches. batch_size cuts batches by place where the payoffs
    have none of their own. Batches are few and a batch's sums are one row, so the windows over them are small;
    the path itself is a running sum over clusters.
    """
    from quillon.plans.prefix import numbered, running

    p = numbered(payoff, "first", name="n").withColumn("i", F.col("n") - 1)
    p = p.withColumn("batch", F.floor(F.col("i") / batch_size)) if batch_size else p
    per = p.groupBy("batch").agg(F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sx2"), F.min("i").alias("at"))
    before = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    raw = (F.lit(margin) + F.coalesce(F.sum("sx").over(before), F.lit(0.0))) / (F.lit(margin * margin + 0.25) + F.coalesce(F.sum("sx2").over(before), F.lit(0.0)))
    lam = per.select("batch", F.greatest(F.lit(0.0), F.least(F.lit(0.5 / (1.0 - margin)), raw)).alias("lam"))
    p = p.join(lam, "batch")
    return running(p, "i", {"log_wealth": F.log1p(F.col("lam") * F.col("x"))}).select("batch", "i", "x", "lam", "log_wealth")


def verdict(path: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(n, max_log_wealth, accepted_at): accepted once wealth has reached 1/alpha, and for good."""
    return path.agg(F.count("*").alias("n"), F.greatest(F.max("log_wealth"), F.lit(0.0)).alias("max_log_wealth"), F.min(F.when(F.col("log_wealth") >= log(1.0 / alpha), F.col("i") + 1)).alias("accepted_at"))


def promotion_rate(events: DataFrame, window: int = 50, order: str = "seq") -> DataFrame:
    """The share of the last gate evaluations that passed; 0 without any."""
    last = events.where(F.col("kind") == "gate_evaluation").orderBy(F.col(order).desc()).limit(window)
    return last.agg(F.coalesce(F.avg(F.col("gate_passed").cast("int")), F.lit(0.0)).alias("promotion_rate"))


def cost_ratio(cand: Column, champ: Column) -> Column:
    """Mean cost against the champion's; of a free champion, 1 if the candidate is free too, else infinite."""
    return F.when(champ > 0, cand / F.when(champ > 0, champ)).when(cand <= 0, 1.0).otherwise(float("inf"))


def efficiency_ratios(costs: DataFrame, cand: str = "cand", champ: str = "champ") -> DataFrame:
    """(cost_ratio, call_ratio) from rows (arm, usd, tool_calls); both arms need rows."""
    g = costs.agg(*(F.avg(F.when(F.col("arm") == arm, F.col(c).cast("double"))).alias(f"{arm}_{c}") for arm in (cand, champ) for c in ("usd", "tool_calls")))
    return g.select(cost_ratio(F.col(f"{cand}_usd"), F.col(f"{champ}_usd")).alias("cost_ratio"), cost_ratio(F.col(f"{cand}_tool_calls"), F.col(f"{champ}_tool_calls")).alias("call_ratio"))


class EProcess:
    """The same test fed batch by batch on the driver, for one stream."""

    def __init__(self, margin: float = 0.02, alpha: float = 0.05) -> None:
        if not 0 <= margin < 0.5 or not 0 < alpha < 1:
            raise ValueError("margin must lie in [0, 0.5) and alpha in (0, 1)")
        self.margin, self.alpha, self.cap = margin, alpha, 0.5 / (1 - margin)
        self.log_wealth = self.max_log_wealth = 0.0
        self.sum_x, self.sum_x2, self.n, self.accepted_at = margin, margin * margin + 0.25, 0, None
        self.seen: set = set()

    def update(self, rows: list[tuple[int, float, float, str]]) -> float:
        """rows of (y, cand, champ, pid); returns the log wealth. A cluster seen before is refused."""
        sums: dict[str, list[float]] = {}
        for y, cand, champ, pid in rows:
            if y == 1:
                sums.setdefault(pid, []).append(cand - champ)
        if again := sorted(self.seen & sums.keys()):
            raise ValueError(f"clusters already bet on: {again[:3]}")
        self.seen |= sums.keys()
        lam = min(max(self.sum_x / self.sum_x2, 0.0), self.cap)
        for d in sums.values():
            x = sum(d) / len(d) + self.margin
            self.log_wealth += log(1 + lam * x)
            self.max_log_wealth = max(self.max_log_wealth, self.log_wealth)
            self.n += 1
            if self.accepted_at is None and self.log_wealth >= log(1 / self.alpha):
                self.accepted_at = self.n
            self.sum_x += x
            self.sum_x2 += x * x
        return self.log_wealth
