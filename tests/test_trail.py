"""The evidence of cases: chains that a plain fold repeats, and findings whose references lead to their entries."""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict

import pytest

from quillon.operators import case_path, events, trail


@pytest.fixture(scope="module")
def ran(spark):
    cases = spark.createDataFrame([(1, "adequate"), (2, "adequate"), (3, "inadequate_defer"), (4, "degraded"), (5, "adequate")], "case_id bigint, qc string")
    box = "case_id bigint, {} bigint, x0 int, y0 int, x1 int, y1 int, score double"
    candidates = spark.createDataFrame([(1, 7, 0, 0, 10, 10, 0.9), (1, 8, 50, 50, 60, 60, 0.4), (2, 1, 0, 0, 5, 5, 0.1), (3, 1, 0, 0, 9, 9, 0.9), (4, 3, 5, 5, 25, 25, 0.8), (4, 4, 5, 5, 25, 25, 0.7)], box.format("candidate_id"))
    reads = spark.createDataFrame([(c, r, *b, 0.8) for c, b in ((1, (0, 0, 10, 10)), (4, (5, 5, 24, 25))) for r in range(5)], box.format("read_id"))
    blind = spark.createDataFrame([], "case_id bigint, x0 int, y0 int, x1 int, y1 int, score double")
    segments = spark.createDataFrame([(4, 4, True, None, 9.0)], "case_id bigint, candidate_id bigint, found boolean, reason string, aspect_ratio double")
    run = case_path.run(cases, candidates, reads, blind, segments=segments)
    return run, *trail.trail(run)


def test_chains_are_whole(ran):
    run, entries, _ = ran
    rows = sorted(entries.collect(), key=lambda r: (r.case_id, r.seq.stage, r.seq.candidate_id or -1))
    by = defaultdict(list)
    for r in rows:
        by[r.case_id].append(r)
    assert {c: [r.kind for r in found] for c, found in by.items()} == {
        1: ["route", "tool_result", "tool_result", "tool_result", "claim", "decision"], 2: ["route", "tool_result", "decision"], 3: ["route", "decision"],
        4: ["route", "tool_result", "tool_result", "tool_result", "tool_result", "claim", "decision"], 5: ["route", "tool_result", "decision"],
    }
    for found in by.values():
        sha = "0" * 64
        for r in found:
            assert r.prev_sha == sha
            sha = hashlib.sha256(f"{r.body}|{sha}".encode()).hexdigest()
            assert r.entry_sha == sha
    checked = events.verify_chain(entries, "case_id", "seq", "body").collect()
    assert len(checked) == 5 and all(r.intact and r.entries == len(by[r.case_id]) and r["head"] == by[r.case_id][-1].entry_sha for r in checked)
    decided = {r.case_id: (r.decision, r.n_kept) for r in run.cases.collect()}
    for c, found in by.items():
        said = json.loads(found[-1].body)
        assert (said["decision"], said["claims"]) == decided[c]


def test_findings_cite_what_they_rest_on(ran):
    run, entries, cited = ran
    at = {r.entry_sha: r for r in entries.collect()}
    rows = cited.collect()
    assert sorted((r.case_id, r.candidate_id) for r in rows) == sorted((r.case_id, r.candidate_id) for r in run.findings.collect()) == [(1, 7), (4, 3)]
    claims = {(r.case_id, r.seq.candidate_id): json.loads(r.body) for r in at.values() if r.kind == "claim"}
    for r in rows:
        tools = [json.loads(at[sha].body)["tool"] for sha in r.evidence]
        assert tools == ["run_detector", "verify"] and all(at[sha].case_id == r.case_id for sha in r.evidence)
        assert [at[sha].seq.candidate_id for sha in r.evidence] == [None, r.candidate_id]
        assert claims[r.case_id, r.candidate_id]["evidence"] == r.evidence and claims[r.case_id, r.candidate_id]["assessment"] == r.assessment


def test_a_changed_entry_breaks_its_chain_alone(ran):
    from pyspark.sql import functions as F

    _, entries, _ = ran
    forged = entries.withColumn("body", F.when((F.col("case_id") == 4) & (F.col("kind") == "claim"), F.regexp_replace("body", "present|uncertain|absent", "certain")).otherwise(F.col("body")))
    assert {r.case_id: r.intact for r in events.verify_chain(forged, "case_id", "seq", "body").collect()} == {1: True, 2: True, 3: True, 4: False, 5: True}
