"""The evidence of every case as one hash chain: route, tool results, claims that cite them, decision."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.case_path import Run
from quillon.operators.events import GENESIS, chain
from quillon.plans.written import written

#: Places of the kinds of entries in a case; entries of one kind come in order of their candidates.
ROUTE, DETECTOR, VERIFY, SEGMENT, CLAIM, DECISION = range(6)


def _entry(df: DataFrame, stage: int, kind: str, body: Column, candidate: Column | None = None) -> DataFrame:
    at = F.struct(F.lit(stage).alias("stage"), (F.lit(None).cast("bigint") if candidate is None else candidate.cast("bigint")).alias("candidate_id"))
    return df.select("case_id", at.alias("seq"), F.lit(kind).alias("kind"), body.alias("body"))


def _told(**fields: Column) -> Column:
    """A JSON object of the fields in order of their names, nulls included; numbers that aren't whole have six digits."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def _six(x: str) -> Column:
    return F.format_string("%.6f", F.col(x).cast("double"))


def evidence(run: Run) -> DataFrame:
    """(case_id, seq, kind, body) of what the tools found: a row for each case's route and detector, and for each check of an examined candidate."""
    cases, checked = run.cases, run.candidates.where("examined")
    counted = cases.join(run.candidates.groupBy("case_id").agg(F.count("*").alias("_n")), "case_id", "left")
    result = lambda tool, **found: _told(tool=F.lit(tool), candidate_id=F.col("candidate_id"), **found)
    parts = [
        _entry(cases, ROUTE, "route", _told(lane=F.col("lane"), qc=F.col("qc"))),
        _entry(counted.where("lane is not null"), DETECTOR, "tool_result", _told(tool=F.lit("run_detector"), candidates=F.coalesce("_n", F.lit(0)))),
        _entry(checked, VERIFY, "tool_result", result("verify", reproduced=F.col("reproduced"), zoom_confirmed=F.col("zoom_confirmed"), score=_six("score"), box=F.array("x0", "y0", "x1", "y1")), F.col("candidate_id")),
        _entry(checked.where("veto_reason is not null"), SEGMENT, "tool_result", result("segment", veto=F.col("veto_reason")), F.col("candidate_id")),
    ]
    return reduce(DataFrame.unionByName, parts)


def trail(run: Run) -> tuple[DataFrame, DataFrame]:
    """(entries, findings): the chained entries (case_id, seq, kind, body, prev_sha, entry_sha) of all cases, and the findings with evidence.

    evidence holds the hashes of the entries that a finding rests on: the detector's, and those of its own candidate, in order.
    A claim's body has them too, so it vouches for what it cites; the decision's body has the number of claims. One chain a
    case; verify_chain(entries, "case_id", "seq", "body") accepts it. Claims are chained after what they cite has its hashes,
    from where their case's chain then ends; both parts are written.
    """
    first = written(chain(evidence(run), "case_id", "seq", "body"), "evidence")
    heads = first.groupBy("case_id").agg(F.max_by("entry_sha", "seq").alias("_start"))
    own = first.where(F.col("seq.candidate_id").isNotNull()).groupBy("case_id", F.col("seq.candidate_id").alias("candidate_id")).agg(F.array_sort(F.collect_list(F.struct("seq.stage", "entry_sha"))).alias("_own"))
    seen = first.where(F.col("seq.stage") == DETECTOR).select("case_id", F.col("entry_sha").alias("_seen"))
    cited = run.findings.join(own, ["case_id", "candidate_id"]).join(seen, "case_id")
    cited = cited.withColumn("evidence", F.concat(F.array("_seen"), F.transform("_own", lambda x: x["entry_sha"]))).drop("_own", "_seen")
    cited = written(cited, "cited")

    claims = _entry(cited, CLAIM, "claim", _told(candidate_id=F.col("candidate_id"), assessment=F.col("assessment"), score=_six("score"), evidence=F.col("evidence")), F.col("candidate_id"))
    counted = run.cases.join(cited.groupBy("case_id").agg(F.count("*").alias("_n")), "case_id", "left")
    decisions = _entry(counted, DECISION, "decision", _told(decision=F.col("decision"), reason=F.col("deferral_reason"), case_score=_six("case_score"), claims=F.coalesce("_n", F.lit(0))))
    rest = claims.unionByName(decisions).join(heads, "case_id", "left").withColumn("_start", F.coalesce("_start", F.lit(GENESIS)))
    last = chain(rest, "case_id", "seq", "body", "_start").drop("_start")
    return first.unionByName(written(last, "claims")), cited
