"""The whole case path over all cases at once: QC, lane, verification, score, rules, student, costly lane, conformal override, findings.

Stages whose tables are not given are left out: crops (zoom), segments (veto), head (calibrated score), thresholds
(conformal override), student, answers (the costly adjudicator behind the breaker).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import conformal
from quillon.operators.candidates import DEFAULTS, assess, case_score, decide, disagreement, escalate, features, lane, reproduction, unexamined, veto, zoom_budget, zoom_confirm
from quillon.operators.events import admitted
from quillon.operators.learners import Student
from quillon.plans.written import written


class Run(NamedTuple):
    """cases: a row each, with decision and route; candidates: the verified ones of routed cases; findings; reviews: a row for each deferral."""

    cases: DataFrame
    candidates: DataFrame
    findings: DataFrame
    reviews: DataFrame


def verified(routed: DataFrame, candidates: DataFrame, reads: DataFrame, n_reads: int, p: dict, crops: DataFrame | None = None, segments: DataFrame | None = None) -> DataFrame:
    """The candidates of routed(case_id, lane) with examined, reproduction, zoom and veto; in the fast lane none is looked at and none is kept."""
    mine = candidates.join(routed.where("lane is not null").select("case_id", "lane"), "case_id")
    slow = reproduction(mine.where("lane <> 'fast_negative'").drop("lane"), reads, n_reads, least=p["min_reproduced"])
    none = {"reproduced": F.lit(0).cast("bigint"), "reproduced_fraction": F.lit(0.0), "kept": F.lit(False)}
    out = slow.withColumn("examined", F.lit(True)).unionByName(mine.where("lane = 'fast_negative'").drop("lane").withColumns(none | {"examined": F.lit(False)}))
    out = out.withColumn("zoom_confirmed", F.lit(None).cast("boolean")) if crops is None else zoom_confirm(zoom_budget(out, p["max_zoom_crops"]), crops, p["zoom_score_ratio"])
    if segments is None:
        return out.withColumns({"veto_reason": F.lit(None).cast("string"), "vetoed": F.lit(False)})
    seen = segments.select("case_id", "candidate_id", "found", F.coalesce("reason", F.lit("")).alias("reason"), "aspect_ratio")
    # doubt alone is no veto: a candidate without a segmentation stays
    why = veto(F.coalesce("found", F.lit(True)), F.col("reason"), F.col("aspect_ratio"), p["fp_max_aspect_ratio"])
    out = out.join(seen, ["case_id", "candidate_id"], "left").withColumn("veto_reason", F.when(F.col("kept"), why)).drop("found", "reason", "aspect_ratio")
    return out.withColumn("vetoed", F.col("veto_reason").isNotNull()).withColumn("kept", F.col("kept") & ~F.col("vetoed"))


def run(
    cases: DataFrame, candidates: DataFrame, reads: DataFrame, blindspots: DataFrame, n_reads: int = 5, policy: dict | None = None, *, crops: DataFrame | None = None, segments: DataFrame | None = None,
    head: str | None = None, thresholds: DataFrame | None = None, student: Student | None = None, answers: DataFrame | None = None, batch: str | None = None, order: str = "case_id", spacing: tuple[float, float] = (0.1, 0.1), mean_order: list[Column] | None = None,
) -> Run:
    """Run every case of cases(case_id, qc; a head score named by head; a breaker's batch named by batch).

    Inadequate cases are deferred with score 0.5 and disagreement 1; they take no lane and the breaker doesn't see them.
    Rows of lanes, verified candidates and escalations are written once each, since later stages read them several times.
    case_id must be unique in cases; candidates, reads and blind spots of other cases are ignored. answers has
    (case_id, decision) of the costly adjudicator; a granted case without an answer keeps its rule verdict. spacing is
    (y, x) millimetres a pixel. With mean_order the mean fraction that a student sees is summed in that order of the verified
    candidates, as doubles; without it is exact.
    """
    p = DEFAULTS | (policy or {})
    bad = F.col("qc").eqNullSafe("inadequate_defer")
    missed = unexamined(blindspots, candidates, p["blindspot_min_score"])
    tops = candidates.groupBy("case_id").agg(F.max("score").alias("_top"), F.count("*").alias("_any"))
    out = cases.join(tops, "case_id", "left").join(missed.groupBy("case_id").agg(F.count("*").alias("n_blindspot")), "case_id", "left").withColumn("n_blindspot", F.coalesce("n_blindspot", F.lit(0)))
    out = out.withColumn("lane", F.when(~bad, lane(F.col("_top"), F.col("n_blindspot"), p["fast_negative_max_score"], p["fast_negative_requires_blindspot_clean"])))
    out = written(out, "lanes")
    checked = written(verified(out, candidates, reads, n_reads, p, crops, segments), "verified")

    sums = case_score(checked).join(checked.groupBy("case_id").agg(F.count_if("kept").alias("n_kept")), "case_id")
    out = out.join(sums, "case_id", "left").join(disagreement(reads), "case_id", "left")
    score = F.coalesce("case_score", F.lit(0.0))
    if head is not None:
        score = 0.5 * score + 0.5 * F.coalesce(head, F.lit(0.0))
    # no candidates, nothing to disagree on
    split = F.when((F.col("lane") == "routine") & F.col("_any").isNotNull(), F.coalesce("disagreement", F.lit(0.0))).otherwise(0.0)
    out = out.withColumns({"n_kept": F.coalesce("n_kept", F.lit(0)), "case_score": F.when(bad, 0.5).otherwise(score), "disagreement": F.when(bad, 1.0).otherwise(split)}).drop("_top", "_any")
    rule = decide(F.col("qc"), F.col("disagreement"), F.col("case_score"), F.col("n_blindspot"), p["band_low"], p["band_high"], p["max_disagreement"])
    out = out.withColumn("decision", rule)
    out = out.withColumn("ambiguous", F.lit(False)) if thresholds is None else conformal.prediction_sets(out, thresholds, "case_score").drop("labels")
    wanted = ~bad & escalate(F.col("decision"), F.col("ambiguous"), F.col("n_blindspot"), p["llm_on_rule_deferral"], p["llm_on_conformal_ambiguous"])
    out = _cascade(out.withColumn("escalation_wanted", wanted), checked, missed, p, student, answers, batch, order, mean_order)

    final = F.when(bad, F.col("decision")).otherwise(conformal.override(F.col("decision"), F.col("ambiguous")))
    why = F.when(bad, "preflight QC").when(F.col("decision") != "defer_to_human", "conformal set is not a singleton").when(F.col("student_absorbed"), "student").when(F.col("llm_invoked"), "costly adjudicator").otherwise("rules")
    out = out.withColumns({"deferral_reason": F.when(final == "defer_to_human", why), "decision": final})
    kept = ("case_id", "qc", "lane", "n_kept", "case_score", "disagreement", "n_blindspot", "escalation_wanted", "student_absorbed", "llm_invoked", "llm_denied_by_cap", "decision", "deferral_reason")
    out = out.select(*kept)
    found = _findings(checked, spacing)
    return Run(out, checked, found, _reviews(out, found))


def _cascade(out: DataFrame, checked: DataFrame, missed: DataFrame, p: dict, student: Student | None, answers: DataFrame | None, batch: str | None, order: str, mean_order: list[Column] | None) -> DataFrame:
    """Escalated cases go to the student if it is sure enough, else to the costly adjudicator while the breaker grants it."""
    off = F.lit(False)
    if student is None or p["student_min_confidence"] is None:
        out = out.withColumn("student_absorbed", off)
    else:
        told = features(out.where("escalation_wanted").select("case_id", "case_score", "disagreement", "qc"), checked, missed, order=mean_order)
        told = student.predict(told).where(F.col("confidence") >= p["student_min_confidence"]).select("case_id", F.col("decision").alias("_said"))
        out = out.join(told, "case_id", "left").withColumns({"student_absorbed": F.col("_said").isNotNull(), "decision": F.coalesce("_said", "decision")}).drop("_said")
    out = written(out, "escalated")
    if answers is None:
        return out.withColumns({"llm_invoked": off, "llm_denied_by_cap": off})
    wants = F.col("escalation_wanted") & ~F.col("student_absorbed")
    by: Column = F.lit(0) if batch is None else F.col(batch)
    queue = out.where("lane is not null").select("case_id", F.col(order).alias("_order"), by.alias("_batch"), wants.alias("wants"))
    turn = admitted(queue, p["llm_max_fraction"], "_batch", "_order", keep=("case_id",)).select("case_id", "granted")
    said = answers.select("case_id", F.col("decision").alias("_said"))
    out = out.join(turn, "case_id", "left").join(said, "case_id", "left")
    got = F.coalesce("granted", off)
    out = out.withColumns({"llm_invoked": got, "llm_denied_by_cap": wants & ~got, "decision": F.when(got, F.coalesce("_said", "decision")).otherwise(F.col("decision")), "lane": F.when(got, "hard").otherwise(F.col("lane"))})
    return out.drop("granted", "_said")


def _findings(checked: DataFrame, spacing: tuple[float, float]) -> DataFrame:
    """Kept candidates with their longer side in millimetres and the rules' assessment."""
    size = F.greatest((F.col("x1") - F.col("x0")) * spacing[1], (F.col("y1") - F.col("y0")) * spacing[0])
    say = assess(F.col("vetoed"), F.col("reproduced_fraction"), F.col("zoom_confirmed"), F.col("score"))
    return checked.where("kept").select("case_id", "candidate_id", "x0", "y0", "x1", "y1", "score", size.alias("size_mm"), say.alias("assessment"))


def _reviews(cases: DataFrame, found: DataFrame) -> DataFrame:
    """(case_id, reason, regions): deferred cases with their findings in order of candidates, which the detector bounds."""
    regions = found.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("candidate_id", "x0", "y0", "x1", "y1", "size_mm", "score"))).alias("regions"))
    out = cases.where("decision = 'defer_to_human'").select("case_id", F.col("deferral_reason").alias("reason")).join(regions, "case_id", "left")
    empty = F.array().cast(regions.schema["regions"].dataType)
    return out.withColumn("regions", F.coalesce("regions", empty))


def run_cases(cases: DataFrame, candidates: DataFrame, reads: DataFrame, blindspots: DataFrame, n_reads: int = 5, policy: dict | None = None, **stages) -> DataFrame:
    """The cases of run()."""
    return run(cases, candidates, reads, blindspots, n_reads, policy, **stages).cases
