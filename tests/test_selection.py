"""Order statistics by repeated counts of ranges, against a sort."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from quillon.operators.selection import order_statistics, quantiles

RNG = np.random.default_rng(0)
COLUMNS = {
    "uniform": RNG.random(20_000), "tied": np.where(RNG.random(20_000) < 0.35, 0.25, RNG.integers(0, 50, 20_000) / 100), "tails": np.exp(RNG.normal(size=20_000) * 100),
    "signed": np.where(RNG.random(20_000) < 0.5, -1, 1) * 10.0 ** RNG.integers(-300, 300, 20_000), "one": np.full(20_000, 7.5),
}


def test_every_kind_of_column(spark):
    df = spark.createDataFrame(pd.DataFrame(COLUMNS)).repartition(6)
    fractions = [0.0, 0.025, 0.3, 0.5, 0.96, 0.975, 1.0]
    got = quantiles(df, {c: fractions for c in COLUMNS})
    for c, x in COLUMNS.items():
        assert [got[c, f] for f in fractions] == pytest.approx(np.quantile(x, fractions).tolist(), rel=1e-12), c
    ranks = [0, 1, 699, 7000, 13_333, 19_998, 19_999]
    values = order_statistics(df, {c: ranks for c in COLUMNS})
    assert {k: v for k, v in values.items()} == {(c, k): np.sort(x)[k] for c, x in COLUMNS.items() for k in ranks}


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(1.0, None, nan), (3.0, None, 2.0), (None, None, -inf), (2.0, None, inf)], "a double, b double, c double")
    got = quantiles(df, {"a": [0.5, 0.25], "b": [0.5], "c": [0.0]})
    assert got == {("a", 0.5): 2.0, ("a", 0.25): 1.5, ("b", 0.5): None, ("c", 0.0): -inf}
    assert order_statistics(df, {"c": [1, 2], "a": [3, -1]}) == {("c", 1): 2.0, ("c", 2): inf}
    assert np.isnan(order_statistics(df, {"c": [3]})["c", 3])
    assert quantiles(df.limit(0), {"a": [0.5]}) == {("a", 0.5): None}
    many = spark.createDataFrame([(nan,)] * 500 + [(float(k),) for k in range(500)], "a double")
    assert order_statistics(many, {"a": [499]})["a", 499] == 499.0 and np.isnan(order_statistics(many, {"a": [500]})["a", 500])
