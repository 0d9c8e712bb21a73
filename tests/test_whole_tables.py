"""Queries that must read whole tables, over fixtures larger than any bound they once had."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from quillon.plans import cases as v
from quillon.plans.queries import QUERIES


@pytest.fixture(scope="module")
def orders(tmp_path_factory):
    """7200 orders: 1200 records of six policies, with four digits in the last record ids."""
    d = tmp_path_factory.mktemp("orders")
    pd.DataFrame({"o_orderkey": range(7200), "o_custkey": [k * k % 97 for k in range(7200)]}).to_parquet(d / "orders.parquet")
    return str(d)


def test_bank_has_every_order(spark, orders):
    passed = {(f"p{k % 6}", f"r{k // 6:03d}"): k * k % 97 % 3 != 0 for k in range(7200)}
    got = QUERIES["a20_transfer_matrix"](spark, orders).toPandas()
    assert len(got) == 7200 and {(x.policy_id, x.record_id): x.passed for x in got.itertuples()} == passed
    records = [f"r{n:03d}" for n in range(1200)]
    confirmed = [r for n, r in enumerate(records) if n % 4]
    rate = QUERIES["a18_pass_rate"](spark, orders).first().pass_rate
    assert rate == pytest.approx(sum(passed["p1", r] for r in confirmed) / len(confirmed), abs=1e-9)
    worse = sorted(r for r in confirmed if passed["p1", r] and not passed["p2", r])
    row = QUERIES["a19_regressions"](spark, orders).first()
    assert (row.regressions, row.failed, row.first5) == (len(worse), sum(not passed["p2", r] for r in confirmed), ",".join(worse[:5]))
    flips = {(x.record_id, x.policy_id) for x in QUERIES["a20_flips"](spark, orders).collect()}
    assert flips == {(r, f"p{k}") for r in records for k in range(1, 6) if passed[f"p{k - 1}", r] and not passed[f"p{k}", r]}


def test_gate_counts_regressions_of_the_whole_bank(spark, sf_dir):
    r = QUERIES["a19_regressions"](spark, sf_dir).first().regressions
    got = QUERIES["x21_gate"](spark, sf_dir).where("name like '%regression%'").collect()
    assert [x.value for x in got] == [r]


def test_lineage_registers_every_order(spark, orders):
    assert v.registrations(spark, orders).count() == 7200
    from quillon.operators import events

    assert [x.policy_id for x in events.lineage(v.registrations(spark, orders), 7199).orderBy("depth").collect()] == [7199, 3599, 1799, 899, 449, 224, 112, 56, 28, 14, 7]


def test_searches_ask_for_every_twentieth_row_among_all_others(spark, sf_dir):
    e = pd.read_parquet(f"{sf_dir}/embeddings.parquet").sort_values("vec_id", ignore_index=True)
    ids, x = e.vec_id.to_numpy(), np.stack(e.embedding.to_list()).astype(np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near, best = set(), {}
    for i in np.flatnonzero(ids % 20 == 0):
        d = np.round(np.sqrt(((x - x[i]) ** 2).sum(axis=1)), 4)
        near |= {(ids[i], ids[k], n) for n, k in enumerate((k for k in np.lexsort((ids, d)) if k != i), 1) if n <= 5}
        cos = np.where((e.label == e.label[i]) & (ids != ids[i]), unit @ unit[i], -1)
        if cos.max() >= 0.2:
            best[ids[i]] = ids[cos.argmax()]
    assert {(r.query_id, r.atlas_id, r.rank) for r in QUERIES["j6_nearest"](spark, sf_dir).collect()} == near
    assert {r.new_id: r.record_id for r in QUERIES["j5_nearest_record"](spark, sf_dir).collect()} == best
    assert {0, 480} <= {i for i, _, _ in near} and any(k < 20 for _, k, _ in near) and any(k % 2 for k in best.values())


def _cases(sf_dir):
    e = pd.read_parquet(f"{sf_dir}/events.parquet")
    v = e.value / (e.value + 100.0)
    return pd.DataFrame({"pid": e.user_id, "y": (e.event_type == "error").astype(int), "cand": v, "champ": 0.5 * v + 0.5 * ((e.event_id * 7919) % 1000 / 1000.0)})


def test_resampling_by_plain_numpy(spark, sf_dir):
    import hashlib
    import math

    from quillon.operators.resample import weight_matrix

    c, deltas = _cases(sf_dir), []
    who, at = np.unique(c.pid, return_inverse=True)
    weights = weight_matrix(np.array([int(hashlib.md5(str(p).encode()).hexdigest()[:7], 16) for p in who]), np.arange(2000))

    def delta(w):
        pos, neg, sens = np.where(c.y == 1, w, 0), np.where(c.y == 0, w, 0), []
        for s in (c.cand.to_numpy(), c.champ.to_numpy()):
            by = np.argsort(s, kind="stable")
            t = s[by][np.searchsorted(np.cumsum(neg[by]), max(1, math.ceil(0.96 * neg.sum())))]
            sens.append(pos[s > t].sum() / pos.sum())
        return sens[0] - sens[1]

    deltas = [delta(weights[at, it]) for it in range(2000)]
    row = QUERIES["a7_paired_bootstrap"](spark, sf_dir).first()
    assert row.n == 2000 and [row.lo, row.hi] == pytest.approx(list(np.quantile(deltas, [0.025, 0.975])), abs=1e-8)
    assert row.point == pytest.approx(delta(np.ones(len(c))), abs=1e-8)
    gate = {r.name: (r.value, r.passed) for r in QUERIES["x21_gate"](spark, sf_dir).collect()}
    assert gate["primary_non_inferiority"] == (pytest.approx(np.quantile(deltas, 0.025), abs=1e-8), bool(np.quantile(deltas, 0.025) >= -0.02))
    drawn = QUERIES["a6_bootstrap_drawn"](spark, sf_dir).groupBy("arm").count().collect()
    assert {r.arm: r["count"] for r in drawn} == {"cand": 2000, "champ": 2000}


def test_the_gate_by_plain_numpy(spark, sf_dir):
    """The other checks of the gate from the rows themselves."""
    e, o = pd.read_parquet(f"{sf_dir}/events.parquet"), pd.read_parquet(f"{sf_dir}/orders.parquet")
    c = _cases(sf_dir)
    got = {r.name: (r.value, r.passed) for r in QUERIES["x21_gate"](spark, sf_dir).collect()}
    by = c.assign(case=e.event_id).sort_values(["cand", "case"], ignore_index=True)
    tile = [by.iloc[k] for k in np.array_split(np.arange(len(by)), 10)]
    ece = sum(len(t) * abs(t.cand.mean() - t.y.mean()) for t in tile) / len(by)
    tc, th = np.quantile(c.cand[c.y == 0], 0.96), np.quantile(c.champ[c.y == 0], 0.96)
    hits = (c.y == 1) & (c.champ > th)
    same = 1 - (e.event_id % 100 == 0).mean()
    k = o.o_orderkey
    usd, calls = (k % 10).astype(float), (o.o_custkey % 7).where(k % 5 != 0)
    ratio = max(usd[k % 2 == 0].mean() / usd[k % 2 == 1].mean(), calls[k % 2 == 0].mean() / calls[k % 2 == 1].mean())
    want = {"calibration_ece": (ece, ece <= 0.1), "negative_flip_rate": ((hits & (c.cand <= tc)).sum() / max(hits.sum(), 1), None), "determinism": (same, same >= 1), "efficiency": (ratio, ratio <= 1.1)}
    for name, (value, passed) in want.items():
        assert got[name][0] == pytest.approx(value, abs=1e-8) and (passed is None or got[name][1] == passed), name


def test_hashed_weights_are_as_wide_as_true_draws(spark):
    """Counts have mean and variance 1, and the spread of a resampled mean is that of draws with replacement."""
    from quillon.operators.resample import drawn_weights, hashed_weights, weight_matrix

    rng = np.random.default_rng(2)
    w, true = weight_matrix(rng.integers(0, 1 << 28, 300), np.arange(2000)), drawn_weights([str(k) for k in range(300)], 2000).T
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and w.max() >= 6
    x = rng.normal(size=300)
    width = [np.quantile((x[:, None] * v).sum(axis=0) / v.sum(axis=0), [0.025, 0.975]) for v in (w, true)]
    assert np.diff(width[0]) == pytest.approx(np.diff(width[1]), rel=0.08)
    few = spark.createDataFrame([(f"P{k}",) for k in range(40)], "pid string")
    import hashlib

    got = {(r.pid, r.it): r.w for r in hashed_weights(few, 30).collect()}
    want = weight_matrix(np.array([int(hashlib.md5(f"P{k}".encode()).hexdigest()[:7], 16) for k in range(40)]), np.arange(30))
    assert got == {(f"P{k}", it): want[k, it] for k in range(40) for it in range(30)}


def test_resampling_of_odd_tables(spark):
    from quillon.operators.resample import paired_delta, resampled_sensitivity

    kind = "pid string, y int, cand double, champ double"
    assert resampled_sensitivity(spark.createDataFrame([], kind), ["cand"], 5).count() == 0
    none = paired_delta(spark.createDataFrame([("a", 0, 0.1, 0.2), ("b", 0, 0.3, 0.1)], kind), 20).first()
    assert none.n == 0 and none.lo is None
    some = paired_delta(spark.createDataFrame([(f"p{k}", k % 2, 0.5, 0.5) for k in range(40)] + [(None, 1, 0.9, 0.1), ("p1", 1, None, 0.1)], kind), 20).first()
    assert some.n > 0 and some.lo <= some.hi


def test_heads_have_the_settings_of_the_reference(spark, sf_dir):
    c = _cases(sf_dir)
    logit, y = np.log((c.cand + 1e-9) / (1 - c.cand + 1e-9)).to_numpy(), c.y.to_numpy()
    nll = {}
    for t in np.geomspace(0.1, 10.0, 120):
        p = 1 / (1 + np.exp(-np.clip(logit / t, -30, 30)))
        nll[float(t)] = -(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)).mean()
    row = QUERIES["x11_temperature"](spark, sf_dir).first()
    assert row.t == pytest.approx(min(nll, key=nll.get), abs=1e-6) and row.nll == pytest.approx(min(nll.values()), abs=1e-7)
    from quillon.operators import learners

    want = learners.fit_head(v.cases(spark, sf_dir), ["cand", "champ"], epochs=400)
    assert [r.weight for r in QUERIES["x10_fit_head"](spark, sf_dir).orderBy("k").collect()] == pytest.approx([*want.weights, want.bias])


def test_tags_are_judged_whole(spark, tmp_path):
    texts = ["good_tag", "a" * 64, "a" * 65, "a" * 20 + " b", "a" * 30 + "!"]
    pd.DataFrame({"doc_id": range(5), "source": ["web"] * 5, "text": texts}).to_parquet(tmp_path / "documents.parquet")
    got = {r.doc_id: r.valid for r in QUERIES["p10_tags"](spark, str(tmp_path)).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: False}


def test_image_queries_are_the_kernels(spark, sf_dir, tmp_path):
    """Each image query, row by row, against the plain kernel on the same pixels, for 24 vectors."""
    pd.read_parquet(f"{sf_dir}/embeddings.parquet").head(24).to_parquet(tmp_path / "embeddings.parquet")
    sf_dir = str(tmp_path)
    from quillon.operators import kernels as k
    from quillon.plans.queries import _images

    images = {r.case_id: np.array(r.pixels, np.float32).reshape(r.h, r.w) for r in _images(spark, sf_dir).collect()}
    vectors = pd.read_parquet(f"{sf_dir}/embeddings.parquet").set_index("vec_id").embedding
    assert set(images) == set(vectors.index)
    for c, im in images.items():
        levels = np.clip(0.5 + 1.5 * vectors[c].astype(np.float64), 0, 1).astype(np.float32)
        assert (im == np.kron(levels.reshape(8, 8), np.ones((8, 8), np.float32))).all()
    rows = lambda name: [r.asDict() for r in QUERIES[name](spark, sf_dir).collect()]
    boxes = {(c, f"p{n}"): b for c, im in images.items() for n, b in enumerate(k.propose(im))}
    assert {(r["case_id"], r["candidate_id"]): (r["x0"], r["y0"], r["x1"], r["y1"], r["score"]) for r in rows("x2_detect")} == boxes
    some = list(images)[::20]
    assert sorted((r["case_id"], r["read_id"], r["x0"], r["y0"], r["score"]) for r in rows("x3_reads") if r["case_id"] in some) == sorted((c, b[0], b[1], b[2], b[5]) for c in some for b in k.shifted_reads(images[c]))
    for name, fn in (("x5_segments", k.segment), ("x6_measurements", k.measure)):
        got = {(r.pop("case_id"), r.pop("candidate_id")): r for r in rows(name)}
        assert got.keys() == boxes.keys()
        for (c, n), r in got.items():
            want = fn(images[c], boxes[c, n][:4])
            assert {x: r[x] for x in want} == want
    assert {r["case_id"]: r["ahash"] for r in rows("h7_average_hash")} == {c: k.average_hash(im) for c, im in images.items()}
    for r in rows("x9_embeddings"):
        assert r["embedding"] == pytest.approx(k.embed(images[r["case_id"]]).tolist(), abs=1e-5)
    assert {(r["dy"], r["dx"], r["passed"]) for r in rows("x7_registrations")} == {(4, 3, True)}
    assert {(r["status"], r["change"]) for r in rows("x8_comparisons")} == {("compared", "stable_within_measurement_error")}


def test_drawn_cases_follow_the_table(spark, sf_dir):
    from quillon.sources.phantom import generate

    keys = pd.read_parquet(f"{sf_dir}/supplier.parquet").s_suppkey.tolist()
    got = {r.patient_id: r.label for r in QUERIES["s13_phantom"](spark, sf_dir).collect()}
    whole = {r.patient_id: r.label for r in generate(spark, patients=max(keys) + 1, images=1, prevalence=0.5, size=96).select("patient_id", "label").collect()}
    assert got == {f"P{k:04d}": whole[f"P{k:04d}"] for k in keys}


def test_logistic_query_has_a_zero_gradient(spark, sf_dir):
    c = _cases(sf_dir)
    x = c[["cand", "champ"]].to_numpy()
    y = np.where(c.cand > 0.65, 0, np.where(c.cand < 0.35, 1, 2))
    z = np.column_stack([(x - x.mean(axis=0)) / x.std(axis=0), np.ones(len(x))])
    rows = sorted(QUERIES["x13_fit_logistic"](spark, sf_dir).collect(), key=lambda r: (["recall", "no_recall", "defer_to_human"].index(r["class"]), r.k))
    for k in range(3):
        w = np.array([r.weight for r in rows[3 * k : 3 * k + 3]])
        assert np.abs(z.T @ (1 / (1 + np.exp(-(z @ w))) - (y == k)) + 1e-3 * w).max() < 1e-3 * len(x)


def _reference_intervals(y, s, pid, its=400):
    import hashlib

    from quillon.operators.resample import weight_matrix

    code = np.array([int(hashlib.md5(str(p).encode()).hexdigest()[:7], 16) for p in pid], dtype=np.uint64)
    w = np.concatenate([np.ones((len(y), 1)), weight_matrix(code, np.arange(its))], axis=1)
    brier = ((s - y) ** 2) @ w / w.sum(axis=0)
    hit = ((s >= 0.5) == (y == 1)) @ w / w.sum(axis=0)
    auroc, sens = [], []
    order = np.argsort(s, kind="stable")
    for c in w.T:
        p, n = c * (y == 1), c * (y == 0)
        below = np.array([n[order][: np.searchsorted(s[order], v)].sum() for v in s])
        tied = np.array([n[s == v].sum() for v in s])
        auroc.append((p * (below + tied / 2)).sum() / (p.sum() * n.sum()) if p.sum() and n.sum() else np.nan)
        k = min(max(int(np.ceil(0.96 * n.sum())), 1), n.sum()) if n.sum() else 0
        cut = s[order][np.searchsorted(np.cumsum(n[order]), k)] if k else np.nan
        sens.append(p[s > cut].sum() / p.sum() if p.sum() and n.sum() else np.nan)
    return {"brier": brier, "accuracy": hit, "auroc": np.array(auroc), "sensitivity": np.array(sens)}


@pytest.mark.parametrize("partitions", [1, 40])
def test_intervals_of_any_metric(spark, partitions):
    """A third of the scores tie, patients have several cases, some rows have no place; against weighted numpy."""
    from quillon.operators import intervals

    rng = np.random.default_rng(partitions)
    n = 300
    pid = rng.integers(0, 120, n)
    y = (rng.random(n) < 0.4).astype(int)
    s = np.clip(np.round(0.3 * y + rng.random(n) * 0.7, 2), 0, 1)
    s[rng.permutation(n)[:100]] = 0.5
    rows = [(int(a), int(b), float(c)) for a, b, c in zip(pid, y, s, strict=True)]
    odd = [(None, 1, 0.3), (1, None, 0.2), (2, 1, None), (3, 0, float("nan")), (4, 2, 0.1)]
    df = spark.createDataFrame(rows + odd, "pid int, y int, score double").repartition(min(partitions, 9))
    want = _reference_intervals(y, s, pid)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        for name, metric in {"brier": intervals.Brier(), "accuracy": intervals.Accuracy(), "auroc": intervals.Auroc(), "sensitivity": "sensitivity"}.items():
            got = intervals.interval(df, metric, 400).first()
            lo, hi = np.nanquantile(want[name][1:], [0.025, 0.975])
            assert (got.point, got.lo, got.hi, got.n) == (pytest.approx(want[name][0]), pytest.approx(lo), pytest.approx(hi), 400), name
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    empty = intervals.interval(df.limit(0), intervals.Auroc(), 5).first()
    assert tuple(empty) == (None, None, None, 0)
    one = intervals.interval(df.where("y = 1"), intervals.Auroc(), 5).first()
    assert tuple(one) == (None, None, None, 0)


def test_segments_are_cut_until_they_are_small(spark, monkeypatch):
    """Many passes give what one gives, with a score that a third of the cases share, and infinite scores."""
    from quillon.operators import resample

    rng = np.random.default_rng(9)
    n = 4000
    s = rng.random(n)
    s[rng.permutation(n)[: n // 3]] = 0.93
    s[:5], s[5:9] = np.inf, -np.inf
    df = spark.createDataFrame(pd.DataFrame({"pid": rng.integers(0, 900, n), "y": (rng.random(n) < 0.3).astype(int), "a": s, "b": rng.permutation(s)})).repartition(5)
    got = {}
    for rows, cuts in ((20_000, 64), (400, 8)):
        monkeypatch.setattr(resample, "RANGE_ROWS", rows)
        monkeypatch.setattr(resample, "CUTS_OF_ARM", cuts)
        got[rows] = {(r.it, r.arm): r.sensitivity for r in resample.resampled_sensitivity(df, ["a", "b"], 60).collect()}
    assert len(got[400]) == 120 and got[400] == got[20_000]
