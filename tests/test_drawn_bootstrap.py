"""The bootstrap with drawn patients, whose rows are dealt out once."""

from __future__ import annotations

import math
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from quillon.operators import resample
from quillon.plans.written import shared_dir


def test_arms_are_dealt_out_once(spark, monkeypatch):
    """Two arms over 4,000 cases, some without a score, a label or a patient: as plain draws give, and each case is stored once."""
    rng, n = np.random.default_rng(7), 4000
    p = pd.DataFrame({"pid": [f"p{k}" for k in rng.integers(0, 600, n)], "y": (rng.random(n) < 0.3).astype(float), "a": rng.random(n).round(3), "b": rng.random(n)})
    p["a"] += 0.3 * p.y
    p.loc[::97, "b"], p.loc[::89, "y"], p.loc[::83, "pid"] = np.nan, np.nan, None
    df = spark.createDataFrame(pa.Table.from_pandas(p, preserve_index=False)).repartition(6)
    root = Path(shared_dir(spark).removeprefix("file:"))
    before = set(root.iterdir())
    monkeypatch.setattr(resample, "RANGE_ROWS", 100)
    got = {(r.it, r.arm): r.sensitivity for r in resample.bootstrap(df, ["a", "b"], iterations=11, seed=4, chunk=4).collect()}
    names, draws, want = sorted(p.pid.dropna().unique()), np.random.default_rng(4), {}
    for it in range(11):
        weight = dict(zip(names, np.bincount(draws.choice(len(names), size=len(names), replace=True), minlength=len(names)), strict=True))
        for arm in "ab":
            t = p.dropna(subset=["pid", "y", arm])
            s, w = t[arm].to_numpy(), t.pid.map(weight).to_numpy()
            neg, pos = np.where(t.y == 0, w, 0), np.where(t.y == 1, w, 0)
            order = np.argsort(s, kind="stable")
            threshold = s[order][np.searchsorted(np.cumsum(neg[order]), math.ceil(0.96 * neg.sum()))]
            want[it, arm] = pytest.approx(pos[s > threshold].sum() / pos.sum())
    assert got == want
    dealt = [x for x in set(root.iterdir()) - before if x.name.startswith("drawn")]
    assert [spark.read.parquet(str(x)).count() for x in dealt] == [len(p.dropna(subset=["pid", "y"]))]
