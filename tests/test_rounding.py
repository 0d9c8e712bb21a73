"""Results that must not hang on the rounding of sums, nor on the order of rows."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd


def test_mean_fractions_do_not_depend_on_the_order(spark):
    """Five fractions of fifths over 24 candidates have a mean of 0.05, a sum of doubles in some orders more."""
    from quillon.operators import candidates

    orders = sorted(set(permutations([0.4, 0.2, 0.2, 0.2, 0.2])))
    assert len({np.cumsum(x)[-1] / 24 for x in orders}) > 1
    rows = [(c, k, 0.5, f, False, False) for c, x in enumerate(orders) for k, f in enumerate([*x, *[0.0] * 19])]
    checked = spark.createDataFrame(rows, "case_id int, candidate_id int, score double, reproduced_fraction double, kept boolean, vetoed boolean").coalesce(1)
    cases = spark.createDataFrame([(c, 0.0, 0.0, "adequate") for c in range(len(orders))], "case_id int, case_score double, disagreement double, qc string")
    got = candidates.features(cases, checked, checked.where("false")).collect()
    assert len(got) == len(orders) and {r.mean_reproduced_fraction for r in got} == {0.05}


def test_average_hashes_tell_neighbouring_levels_apart(spark, tmp_path, same):
    """Entries a few units of a float apart, so that the median lies between neighbours."""
    import duckdb

    from quillon.plans.queries import ORACLE_SQL, QUERIES

    rng = np.random.default_rng(4)
    near = [(rng.uniform(-0.2, 0.2) + rng.integers(0, 3, 64) * 6e-8).astype(np.float32) for _ in range(60)]
    vectors = near + [rng.normal(size=64).astype(np.float32) for _ in range(20)]
    pd.DataFrame({"vec_id": range(len(vectors)), "embedding": [x.tolist() for x in vectors], "label": 0}).astype({"label": "int32"}).to_parquet(tmp_path / "e.parquet")
    con = duckdb.connect()
    con.sql(f"copy (select vec_id, embedding::float[] embedding, label from '{tmp_path}/e.parquet') to '{tmp_path}/embeddings.parquet' (format parquet)")
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    same(QUERIES["h7_average_hash"](spark, str(tmp_path)).toPandas(), con.sql(ORACLE_SQL["h7_average_hash"]).df())


def test_weights_are_plain_columns(spark):
    """No function of an array for each of 2,000 rows a patient: those aren't compiled, and steps inside were computed again and again."""
    from quillon.operators.resample import hashed_weights

    plan = hashed_weights(spark.range(3).selectExpr("id as pid"), 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and len(plan) < 20_000
