"""Policies, adjudicators, tools, rules and sinks."""

from __future__ import annotations

import hashlib
import json

import pytest

from quillon.operators.adjudicate import Scripted, Toolbelt
from quillon.operators.policy import Policy, Registry, settings
from quillon.sources import files


def test_policy_ids_and_knobs():
    a, b = Policy(pipeline={"min_reproduced": 3}), Policy(pipeline={"min_reproduced": 4})
    assert a.policy_id() == Policy(pipeline={"min_reproduced": 3}).policy_id() != b.policy_id()
    assert settings(a)["min_reproduced"] == 3
    for bad in (Policy(pipeline={"code": "x"}), Policy(router={"llm_max_fraction": 2}), Policy(adjudicator={"kind": "llm"}), Policy(router={"student_id": "s"}), Policy(adjudicator={"nope": 1})):
        with pytest.raises(ValueError):
            settings(bad)
    assert settings(Policy(router={"student_id": "s"}), "s")["band_low"] == 0.35


def test_registry():
    r, a, b = Registry(), Policy(), Policy(pipeline={"min_reproduced": 2})
    x = r.register(a)
    y = r.register(b, x)
    assert r.register(b, x) == y and len(r.lineage.entries) == 2 and r.champion() is None
    for summary, ok in (("GATE: PASS", False), (" ", True), ("GATE: FAIL", True)):
        with pytest.raises(PermissionError):
            r.promote(y, summary, ok)
    with pytest.raises(PermissionError):
        r.rollback(x, "why")
    r.promote(x, "GATE: PASS", True)
    r.promote(y, "GATE: PASS", True)
    with pytest.raises(ValueError):
        r.rollback(x, " ")
    r.rollback(x, "worse")
    assert r.champion() == x and r.lineage.verify()
    r.policies[y] = r.policies[y].replace("2", "9")
    with pytest.raises(RuntimeError):
        r.get(y)
    with pytest.raises(KeyError):
        r.register(a, "nobody")


def test_scripted_adjudicator(spark):
    cases = spark.createDataFrame([(k, "adequate", 0.0, s, 0) for k, s in enumerate([0.1, 0.5, 0.9, 0.1, 0.5])], "case_id int, qc string, disagreement double, case_score double, n_blindspot int")
    answers = spark.createDataFrame([(0, "recall", 0.1, 10, None), (1, "recall", 9.0, 10, None), (2, "no_recall", 0.1, 999, None), (3, "recall", 0.0, 0, "timeout")], "case_id int, decision string, usd double, output_tokens int, error string")
    got = {r.case_id: (r.decision, r.fallback_reason) for r in Scripted(answers, 1.0, 100).adjudicate(cases).collect()}
    assert got == {0: ("recall", None), 1: ("defer_to_human", "usd"), 2: ("recall", "output_tokens"), 3: ("no_recall", "timeout"), 4: ("defer_to_human", "no answer")}


def test_toolbelt():
    t = Toolbelt({"double": lambda x: {"y": 2 * x}})
    assert t.call("double", x=2) == t.call("double", x=2) == {"y": 4} and (t.calls, t.hits) == ({"double": 2}, 1)
    with pytest.raises(PermissionError):
        t.call("shell", x=1)
    assert [e["kind"] for e in t.ledger.entries] == ["tool_call", "tool_result", "tool_call", "tool_result_cached"] and t.ledger.verify()


def test_store_and_versions(spark, tmp_path):
    path = str(tmp_path / "store")
    texts = spark.createDataFrame([("look twice\nthen decide",), ("",), (None,), ("",)], "text string")
    ids = {r.id for r in files.write_store(texts, path).collect()}
    files.write_store(texts, path)
    assert len(ids) == 2 and sorted(r.text for r in files.read_store(spark, path).collect()) == ["", "look twice\nthen decide"]
    spark.createDataFrame([("0" * 12, "edited")], "id string, text string").write.mode("append").parquet(path)
    with pytest.raises(Exception, match="does not match"):
        files.read_store(spark, path).collect()
    atlas = tmp_path / "atlas.npz"
    atlas.write_bytes(b"one")
    versions = lambda p: files.derived_versions(spark, {"run_detector": p}, {"retrieve_similar": str(atlas), "lookup_criteria": str(tmp_path / "none"), "other": None})
    a, b = versions({"sigma": 2}), versions({"sigma": 3})
    assert a["run_detector"] != b["run_detector"] and a["retrieve_similar"] == b["retrieve_similar"] == hashlib.sha256(b"one").hexdigest()[:12]
    assert a["lookup_criteria"] == a["other"] == "absent" and a["measure"] == "v1"
    atlas.write_bytes(b"two")
    assert versions({"sigma": 2})["retrieve_similar"] != a["retrieve_similar"]


def test_rules_and_sinks(spark, tmp_path):
    (tmp_path / "rules.json").write_text(json.dumps({"primary": {"specificity": 0.9}, "calibration": {"max_ece_adaptive": 0.2}}))
    assert files.read_rules(str(tmp_path / "rules.json")) == {"specificity": 0.9, "max_ece": 0.2}
    art = spark.createDataFrame([(2, 1, [0.5, 0.5]), (2, 1, [0.5, 0.5]), (1, 2, [0.5, 0.5])], "h int, w int, pixels array<float>")
    for _ in range(2):
        assert len({r.handle for r in files.write_artifacts(art, str(tmp_path / "a")).collect()}) == 2
    assert spark.read.parquet(str(tmp_path / "a")).count() == 2
    r = spark.createDataFrame([("p1", "x", True), ("p2", "x", False)], "policy_id string, record_id string, passed boolean")
    files.write_replays(r, str(tmp_path / "r"))
    files.write_replays(spark.createDataFrame([("p2", "x", True)], r.schema), str(tmp_path / "r"))
    assert {(x.policy_id, x.passed) for x in spark.read.parquet(str(tmp_path / "r")).collect()} == {("p1", True), ("p2", True)}
    for k in range(2):
        files.append_json(spark.createDataFrame([(f"c{k}", "recall", False, {"a": 1.0})], files.TRACE), str(tmp_path / "t"))
    assert files.read_traces(spark, str(tmp_path / "t")).count() == 2
