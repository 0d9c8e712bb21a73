"""Spatial joins against all pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quillon.operators import boxes
from quillon.operators import candidates as cand


def ious(a, b):
    """Of boxes a (n x 4) with boxes b (m x 4)."""
    w = np.minimum(a[:, None, 2], b[:, 2]) - np.maximum(a[:, None, 0], b[:, 0])
    h = np.minimum(a[:, None, 3], b[:, 3]) - np.maximum(a[:, None, 1], b[:, 1])
    common = np.maximum(w, 0) * np.maximum(h, 0)
    area = lambda x: np.maximum(x[:, 2] - x[:, 0], 0) * np.maximum(x[:, 3] - x[:, 1], 0)
    union = area(a)[:, None] + area(b) - common
    return np.where(union > 0, common / np.where(union > 0, union, 1), 0.0)


def frame(spark, x, cases, **more):
    return spark.createDataFrame(pd.DataFrame({"case_id": cases, **more} | {c: x[:, k] for k, c in enumerate(boxes.EDGES)}))


def test_touching_is_exact_at_every_size(spark):
    rng = np.random.default_rng(0)

    def some(n):
        at = rng.integers(-40, 40, (n, 2)) / 2.0
        size = np.where(rng.random((n, 1)) < 0.2, 0, 2.0 ** rng.integers(-4, 8, (n, 1))) * rng.choice([1, 0.3, 1.5, -1], (n, 2))
        return np.concatenate([at, at + size], axis=1)

    a, b = some(250), some(250)
    a[7] = [1e9, 1e9, 1e9, 1e9]
    ca, cb = rng.integers(0, 2, 250), rng.integers(0, 2, 250)
    got = boxes.touching(frame(spark, a, ca, n=range(250)), frame(spark, b, cb, m=range(250)), ["case_id"])
    pairs = [(r.l.n, r.r.m) for r in got.collect()]
    lo = lambda x, k: np.minimum(x[:, k], x[:, k + 2])
    hi = lambda x, k: np.maximum(x[:, k], x[:, k + 2])
    meet = (ca[:, None] == cb) & np.all([(lo(a, k)[:, None] <= hi(b, k)) & (lo(b, k) <= hi(a, k)[:, None]) for k in (0, 1)], axis=0)
    assert len(pairs) == len(set(pairs)) and set(pairs) == set(zip(*np.nonzero(meet), strict=True)) and len(pairs) > 1000


def test_boxes_that_have_no_place(spark):
    rows = [(1, 0.0, 0.0, None, 1.0), (1, 0.0, 0.0, float("nan"), 1.0), (1, 0.0, 0.0, float("inf"), 1.0), (None, 0.0, 0.0, 1.0, 1.0), (1, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "case_id int, x0 double, y0 double, x1 double, y1 double")
    assert boxes.touching(df, df, ["case_id"]).count() == 1
    assert boxes.touching(df.limit(0), df, ["case_id"]).count() == boxes.touching(df, df.limit(0), ["case_id"]).count() == 0


def test_a_case_of_100_000_boxes(spark):
    """50,000 candidates and as many boxes of reads in one case, a tenth of either equal; every result of a random tenth is checked."""
    rng, n = np.random.default_rng(1), 50_000

    def some(least, most):
        at = rng.integers(0, 6000, (n, 2))
        x = np.concatenate([at, at + rng.integers(least, most, (n, 2))], axis=1)
        x[rng.permutation(n)[: n // 10]] = x[0]
        x[rng.permutation(n)[:20], 2:] += 3000
        return x

    a, b, read = some(20, 60), some(20, 60), rng.integers(0, 5, n)
    left, right = frame(spark, a, np.zeros(n, int), candidate_id=range(n), score=rng.random(n)), frame(spark, b, np.zeros(n, int), read_id=read, score=rng.random(n))
    got = cand.reproduction(left.repartition(8), right.repartition(8), 5, least=2).toPandas().sort_values("candidate_id")
    some_rows = rng.permutation(n)[: n // 10]
    want = np.concatenate([np.stack([((ious(a[part], b[read == r]) >= 0.3).any(axis=1)) for r in range(5)]).sum(axis=0) for part in np.array_split(some_rows, 50)])
    assert len(got) == n and (got.reproduced.to_numpy()[some_rows] == want).all() and (got.kept == (got.reproduced >= 2)).all() and 0 < got.kept.mean() < 1
    missed = {r.candidate_id for r in cand.unexamined(left, right, 0.5).select("candidate_id").collect()}
    score = left.orderBy("candidate_id").toPandas().score.to_numpy()
    cx, cy = (a[:, 0] + a[:, 2]) / 2, (a[:, 1] + a[:, 3]) / 2
    for part in np.array_split(some_rows, 50):
        inside = ((cx[part, None] >= b[:, 0]) & (cx[part, None] <= b[:, 2]) & (cy[part, None] >= b[:, 1]) & (cy[part, None] <= b[:, 3])).any(axis=1)
        open_ = (score[part] >= 0.5) & ~inside & ~(ious(a[part], b) > 0.1).any(axis=1)
        assert set(part[open_].tolist()) == missed & set(part.tolist())


def test_columns_of_candidates_stay(spark):
    c = spark.createDataFrame([(1, 1, 0, 0, 10, 10, 0.9), (1, 1, 0, 0, 10, 10, 0.9), (1, 2, None, 0, 5, 5, 0.5), (None, 3, 0, 0, 10, 10, 0.9)], "case_id int, candidate_id int, x0 int, y0 int, x1 int, y1 int, score double").withColumn("l", F.lit("mine"))
    r = spark.createDataFrame([(1, 0, 0, 0, 10, 10, 0.5), (1, 0, 1, 1, 10, 10, 0.5), (1, 1, 0, 0, 9, 9, 0.5)], "case_id int, read_id int, x0 int, y0 int, x1 int, y1 int, score double")
    got = cand.reproduction(c, r, 2, least=2)
    assert got.columns == [*c.columns, "reproduced", "reproduced_fraction", "kept"]
    assert sorted((x.candidate_id, x.reproduced, x.kept) for x in got.collect()) == [(1, 2, True), (1, 2, True), (2, 0, False), (3, 0, False)]
