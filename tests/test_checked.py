"""Chains that are checked as they stream by, and what the answers to tool calls leave on disk."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from quillon.operators import events


def test_entries_are_checked_where_they_lie(spark):
    rows = spark.createDataFrame([(k % 7 if k % 11 else None, k, f"b{k}" if k % 5 else None) for k in range(300)], "c int, seq int, body string")
    whole = spark.createDataFrame(events.chain(rows, "c", "seq", "body").collect(), "c int, seq int, body string, prev_sha string, entry_sha string").coalesce(1)
    assert whole.count() == 300 and events.checked(whole, "c", "body").where("not ok").count() == 0
    bad = lambda df: {r.seq for r in events.checked(df, "c", "body").where("not ok").collect()}
    assert bad(whole.withColumn("body", F.when(F.col("seq") == 8, "other").otherwise(F.col("body")))) == {8}
    assert bad(whole.withColumn("prev_sha", F.when(F.col("seq") != 8, F.col("prev_sha")))) == {8}
    assert bad(whole.where("seq != 8")) == {15}
    assert bad(whole.withColumn("entry_sha", F.when(F.col("seq") == 8, "x").otherwise(F.col("entry_sha")))) == {8, 15}


def test_tool_calls_leave_one_table_of_calls(spark, sf_dir):
    from quillon.plans.queries import QUERIES
    from quillon.plans.written import shared_dir

    before = set(Path(shared_dir(spark)).iterdir())
    got = QUERIES["x20_tool_calls"](spark, sf_dir).collect()
    left = [p.name.split("-")[0] for p in set(Path(shared_dir(spark)).iterdir()) - before]
    assert len(got) == 11 and all(r.intact for r in got)
    assert left.count("originals") == 1 and not {"calls", "results", "entries"} & set(left)
