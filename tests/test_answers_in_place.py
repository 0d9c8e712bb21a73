"""Answers to tool calls: what they shuffle, and that neither ties, batches nor the size of results change the entries."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillon.operators import events, neighbours, toolcalls

COLUMNS = ("case_id", "seq", "kind", "body", "prev_sha", "entry_sha")


@pytest.fixture
def calls(spark):
    rows = [(k, None if k % 13 == 0 else f"c{k % 7}", [None, 1, 1, 2, k][k % 5], "lookup_criteria" if k % 3 else "submit_review", None if k % 17 == 0 else f'{{"topic": "{k % 4}", "case_id": "é{k % 6}"}}') for k in range(200)]
    df = spark.createDataFrame(rows, "call bigint, case_id string, seq int, tool string, arguments string")
    return df.withColumn("key", F.when(F.col("tool") == "lookup_criteria", F.col("arguments")))


@pytest.fixture
def tools(spark):
    return {"lookup_criteria": toolcalls.lookup_criteria(spark.createDataFrame([("1 a", "x"), ("2 b", "y")], "topic string, text string")), "submit_review": lambda c: toolcalls.submit_review()(c.where("arguments is not null"))}


def told(entries):
    return sorted(map(str, entries.select(*COLUMNS).collect()))


def test_calls_are_shuffled_once(spark, calls, tools):
    calls = calls.where("tool = 'submit_review'").withColumn("key", F.when(F.col("call") % 2 == 0, F.col("arguments")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = toolcalls.answer(calls, tools)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 1


def test_ties_batches_and_large_results(spark, calls, tools, monkeypatch):
    entries = toolcalls.answer(calls, tools)
    want = told(entries)
    assert len(want) == 400
    assert told(events.chain(entries.select(*COLUMNS[:4]), "case_id", "seq", "body")) == want
    assert events.checked(entries, "case_id", "body").where("not ok").count() == 0 and all(r.intact for r in events.verify_chain(entries, "case_id", "seq", "body").collect())
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert told(toolcalls.answer(calls, tools)) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    monkeypatch.setattr(toolcalls, "SHARED", -1)
    assert told(toolcalls.answer(calls, tools)) == want


def test_regions_are_no_smaller_than_they_need_be():
    assert [neighbours.balls(n) for n in (0, 2000, 9000, 10**9)] == [1, 1, 2, neighbours.PIVOTS]
