"""Means of doubles on a student's threshold, which must be what the SQL's avg gives and not the exact mean."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon.operators import candidates
from quillon.plans.queries import ORACLE_SQL, QUERIES

#: Two of twelve candidates are reproduced, by one and by two of five reads: 0.2 + 0.4 over 12 is above 0.05 as doubles, in either order.
EVENTS = [(133637, "purchase", 150.0), (150706, "error", 10.0), (164908, "purchase", 10.0), (166940, "error", 10.0), *((k, "view", 40.0) for k in (129034, 139107, 141669, 143215, 166672, 173846, 174266, 179880, 184802, 187072, 194512, 199192))]


def test_means_of_doubles_in_an_order(spark):
    rows = [(c, k, f, False, False, 0.5) for c, x in enumerate([(0.2, 0.4), (0.4, 0.2, 0.2, 0.2, 0.2), (0.2, 0.2, 0.2, 0.2, 0.4)]) for k, f in enumerate([*x, *[0.0] * (12 * min(c, 1) + 12 - len(x))])]
    checked = spark.createDataFrame(rows, "case_id int, candidate_id int, reproduced_fraction double, kept boolean, vetoed boolean, score double").repartition(3, "candidate_id")
    cases = spark.createDataFrame([(c, 0.0, 0.0, "adequate") for c in range(4)], "case_id int, case_score double, disagreement double, qc string")
    mean = lambda order: {r.case_id: r.mean_reproduced_fraction for r in candidates.features(cases, checked, checked.where("false"), order=order).collect()}
    assert mean(None) == {0: 0.05, 1: 0.05, 2: 0.05, 3: 0.0}
    assert mean([F.col("candidate_id")]) == {0: (0.2 + 0.4) / 12, 1: (0.4 + 0.2 + 0.2 + 0.2 + 0.2) / 24, 2: (0.2 + 0.2 + 0.2 + 0.2 + 0.4) / 24, 3: 0.0}
    assert mean([F.col("candidate_id").desc()])[1] == (0.2 + 0.2 + 0.2 + 0.2 + 0.4) / 24 > 0.05


@pytest.mark.parametrize("name", ["x22_run_cases", "x22_reviews", "x23_lane_counts"])
def test_a_case_on_the_threshold_is_as_in_sql(spark, tmp_path, same, name):
    con = duckdb.connect()
    con.sql("create table events (event_id bigint, user_id bigint, event_type varchar, value double)")
    con.executemany("insert into events values (?, ?, ?, ?)", [(e, case, kind, value) for case in (1706, 1707) for e, kind, value in EVENTS])
    con.sql(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    same(QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(ORACLE_SQL[name]).df())
