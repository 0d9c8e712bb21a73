"""Whitening: the eigen-solve and the moments against numpy, exact deviations, edges and the contract query."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from quillon.llm import whitening as w
from quillon.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>"


@pytest.mark.parametrize("d", [1, 2, 3, 7, 64])
def test_symmetric_qr(d):
    rng = np.random.default_rng(d)
    for a in (rng.normal(size=(d, d)), rng.normal(size=(d, 2)) @ rng.normal(size=(2, d)), np.diag(rng.normal(size=d)), np.zeros((d, d)), np.eye(d), np.ones((d, d))):
        a = a + a.T
        values, rows = w.symmetric_qr(a)
        scale = max(np.abs(a).max(), 1e-300) * d
        assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-13 * scale
        assert np.abs(rows @ rows.T - np.eye(d)).max() < 1e-12 and np.abs(rows @ a @ rows.T - np.diag(values)).max() <= 1e-12 * scale


def test_moments_merge_as_one_pass():
    x = np.random.default_rng(0).integers(-500, 500, (700, 9))
    parts, state = [], w.Moments(9)
    for k in (0, 1, 5, 300, 300, 700):
        parts.append(k)
    for a, b in zip(parts, parts[1:], strict=False):
        one = w.Moments(9)
        one.count(x[a:b] + w.SHIFT)
        one.add(x[a:b].astype(float))
        state.merge(one.n, one.mean, one.m2, one.sums)
    assert state.n == 700 and state.sums == (x + w.SHIFT).sum(axis=0).tolist()
    assert np.allclose(state.m2 / 700, np.cov(x.T, bias=True), rtol=1e-12, atol=1e-9) and np.allclose(state.mean, x.mean(axis=0))


def test_deviations_are_exact_at_every_size():
    rng = np.random.default_rng(1)
    for n, top in ((3, 100), (10**9, 10**3), (10**11, 10**6), (10**6, 1 << 45)):
        x = rng.integers(-top, top, (5, 4))
        sums = [int(s) * n // 7 for s in rng.integers(-top, top, 4)]
        got = w.Whitener(n, sums, np.ones(1), np.ones((1, 4)), 1.0).deviations(x)
        assert got == [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]


def reference(rows):
    """The contract by numpy, Python integers and LAPACK."""
    x = {}
    usable = [(i, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)) for i, v in rows]
    for _, v in usable:
        x[v] = None
    fit = np.array(list(x), dtype=np.int64)
    n, sums = len(fit), [sum(col) for col in zip(*x, strict=True)]
    centre = np.array([s / n for s in sums])
    cov = (fit - centre).T @ (fit - centre) / n
    e, q = np.linalg.eigh(cov)
    return usable, n, sums, centre, e[::-1], q[:, ::-1].T, np.trace(cov)


def agrees(got, rows, components=16):
    usable, n, sums, centre, e, q, trace = reference(rows)
    k = min(components, len(e))
    assert len(got) == len(usable) * k and (got.n == n).all()
    by = got.sort_values("component").groupby("vec_id")
    for i, v in usable:
        r = by.get_group(i)
        assert r.component.tolist() == list(range(1, k + 1))
        assert set(map(int, r.deviation)) == {sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))}
        assert r.explained.tolist() == pytest.approx((e[:k] / trace).tolist(), rel=1e-9)
        want = q[:k] @ (np.array(v) - centre) / np.sqrt(e[:k])
        assert np.abs(r.whitened).tolist() == pytest.approx(np.abs(want).tolist(), rel=1e-6, abs=1e-8)
    signs = {i: np.sign(by.get_group(i).whitened.to_numpy() * (q[:k] @ (np.array(v) - centre))) for i, v in usable}
    assert all((s == next(iter(signs.values()))).all() for s in signs.values())
    assert got.identity_error.nunique() == 1 and 0 <= got.identity_error.iloc[0] < 1e-9


def test_query(spark, sf_dir):
    rows = pd.read_parquet(f"{sf_dir}/embeddings.parquet")
    agrees(QUERIES["op12_whitening"](spark, sf_dir).toPandas(), list(zip(rows.vec_id, rows.embedding, strict=True)))


def test_edges(spark):
    rng = np.random.default_rng(4)
    good = [(k, rng.normal(size=5).astype(np.float32).tolist()) for k in range(40)]
    good += [(100 + k, good[0][1]) for k in range(30)]  # copies count once
    bad = [(200, None), (201, []), (202, [1.0, None, 1.0, 1.0, 1.0]), (203, [float("nan")] * 5), (204, [float("inf")] * 5), (205, [1.0, 2.0]), (206, [3e38] * 5)]
    df = spark.createDataFrame(good + bad, SCHEMA).selectExpr("*", "'mine' component", "'mine' n", "1 label").repartition(4)
    got = w.whiten(df)
    assert got.columns == ["vec_id", "label", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    agrees(got.drop("label").toPandas(), good)
    assert w.whiten(spark.createDataFrame(bad[:2], SCHEMA)).count() == w.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    repeated = w.whiten(spark.createDataFrame([(None, [1.0, 2.0]), (None, [1.0, 2.0]), (7, [3.0, 2.0]), (7, [3.0, 2.0])], SCHEMA)).toPandas()
    assert len(repeated) == 8 and set(repeated.n) == {2}
    first = repeated[repeated.component == 1]
    assert np.abs(first.whitened).tolist() == [1.0] * 4 and set(first.explained) == {1.0} and first.identity_error.iloc[0] < 1e-12
    assert repeated[repeated.component == 2].whitened.isna().all()
    single = w.whiten(spark.createDataFrame([(1, [0.5, 0.5, 0.5])], SCHEMA)).toPandas()
    assert len(single) == 3 and single.whitened.isna().all() and single.explained.isna().all() and set(map(int, single.deviation)) == {0}
