"""The conjunctive promotion gate: a row for each check, passed if all are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import metrics, resample, sequential

#: The bounds of a gate without rules of its own.
RULES = {
    "specificity": 0.96, "margin": 0.02, "iterations": 2000, "alpha": 0.05, "worst_slice_margin": 0.1, "min_slice_size": 30, "max_ece": 0.1,
    "max_flip_rate": 0.05, "required_agreement": 1.0, "max_regressions": 0, "max_cost_ratio": 1.1, "max_call_ratio": 1.1, "sequential_alpha": 0.05,
}


def row(name: str, df: DataFrame, value: Column, passed: Column) -> DataFrame:
    return df.select(F.lit(name).alias("name"), value.cast("double").alias("value"), F.coalesce(passed, F.lit(False)).alias("passed"))


def run_gate(
    cases: DataFrame, rules: dict | None = None, attributes: list[str] | None = None, champion: bool = True, rerun: str | None = None,
    regressions: DataFrame | None = None, costs: DataFrame | None = None, path: DataFrame | None = None,
) -> DataFrame:
    """(name, value, passed) of every check whose inputs are given.

    cases has case_id, pid, y, cand and, with champion, champ. regressions has a row count column `regressions`,
    costs the rows of both arms, path the wealth of a sequential test. Costs of one arm alone are refused.
    """
    r = RULES | (rules or {})
    spec, checks = r["specificity"], []
    own = cases.withColumn("score", F.col("cand"))
    if champion:
        ci = resample.paired_delta(cases, r["iterations"], alpha=r["alpha"], specificity=spec)
        checks.append(row("primary_non_inferiority", ci, F.col("lo"), F.col("lo") >= -r["margin"]))
    else:
        s = metrics.sensitivity_at_specificity(own, spec)
        checks.append(row("primary_metric", s, F.col("sensitivity"), F.col("sensitivity").isNotNull()))
    if attributes:
        w = metrics.worst_slice(own, attributes, spec, r["min_slice_size"]).agg(F.min("sensitivity").alias("worst"))
        w = w.crossJoin(F.broadcast(metrics.sensitivity_at_specificity(own, spec)))
        checks.append(row("worst_slice_floor", w, F.col("worst"), F.col("worst").isNull() | (F.col("worst") >= F.col("sensitivity") - r["worst_slice_margin"])))
    checks.append(row("calibration_ece", metrics.ece_adaptive(own), F.col("ece"), F.col("ece") <= r["max_ece"]))
    if champion:
        checks.append(row("negative_flip_rate", metrics.negative_flips(cases, spec), F.col("flip_rate"), F.col("flip_rate") <= r["max_flip_rate"]))
    if rerun:
        checks.append(row("determinism", metrics.agreement(cases, "cand", rerun), F.col("agreement"), F.col("agreement") >= r["required_agreement"]))
    if regressions is not None:
        checks.append(row("failure_bank_regression", regressions, F.col("regressions"), F.col("regressions") <= r["max_regressions"]))
    if costs is not None:
        q = sequential.efficiency_ratios(costs)
        checks.append(row("efficiency", q, F.greatest("cost_ratio", "call_ratio"), (F.col("cost_ratio") <= r["max_cost_ratio"]) & (F.col("call_ratio") <= r["max_call_ratio"])))
    if path is not None:
        v = sequential.verdict(path, r["sequential_alpha"])
        checks.append(row("sequential_acceptance", v, F.col("max_log_wealth"), F.col("accepted_at").isNotNull()))
    return reduce(DataFrame.unionByName, checks)


def passed(checks: DataFrame) -> DataFrame:
    return checks.agg(F.every("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))
