"""Operators against plain numpy, and at their edges."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.operators import candidates, case_path, conformal, events, gate, kernels, learners, metrics, resample, sequential, splits


def cohort(n=400, seed=0, ties=False):
    rng = np.random.default_rng(seed)
    s = 1 / (1 + np.exp(-4 * rng.normal(size=n)))
    s = np.round(s, 1) if ties else s
    y = (rng.random(n) < s).astype(int)
    return pd.DataFrame({"case_id": range(n), "pid": [f"P{k // 2}" for k in range(n)], "y": y, "score": s, "site": ["ab"[k % 2] for k in range(n)]})


@pytest.mark.parametrize("ties", [False, True])
def test_rank_metrics(spark, ties):
    p = cohort(ties=ties)
    df = spark.createDataFrame(p)
    pos, neg = p.score[p.y == 1].to_numpy(), p.score[p.y == 0].to_numpy()
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert metrics.auroc(df).first()[0] == pytest.approx(want)
    k = min(max(math.ceil(0.96 * len(neg)), 1), len(neg))
    t = np.sort(neg)[k - 1]
    assert metrics.threshold_at_specificity(df).first()[0] == t
    assert metrics.sensitivity_at_specificity(df).first()[0] == pytest.approx((pos > t).mean())
    assert metrics.brier(df).first()[0] == pytest.approx(((p.score - p.y) ** 2).mean())
    q = p.sort_values(["score", "case_id"])
    parts = [x for x in np.array_split(np.arange(len(q)), 10) if len(x)]
    ece = sum(len(x) * abs(q.score.iloc[x].mean() - q.y.iloc[x].mean()) for x in parts) / len(q)
    assert metrics.ece_adaptive(df).first()[0] == pytest.approx(ece)


def test_partial_auc_is_the_whole_at_zero(spark):
    df = spark.createDataFrame(cohort(ties=True))
    assert metrics.partial_auc(df, 0.0).first()[0] == pytest.approx(metrics.auroc(df).first()[0])
    one = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, score double")
    assert metrics.partial_auc(one).first()[0] is not None


def test_one_class_and_empty(spark):
    one = spark.createDataFrame([(0, 1, 0.5), (1, 1, 0.7)], "case_id int, y int, score double")
    none = one.limit(0)
    for df in (one, none):
        assert metrics.auroc(df).first()[0] is None and metrics.sensitivity_at_specificity(df).first()[0] is None
    assert metrics.ece_adaptive(none).first()[0] is None and metrics.ece_adaptive(one).first()[0] == pytest.approx(0.4)


def test_efficiency_of_known_numbers(spark):
    df = spark.createDataFrame([(y, s, 100 if k < 5 else 0, 0.02 if k < 5 else 0.0, 12000.0 if k < 5 else 0.0) for k, (y, s) in enumerate(zip([0, 0, 0, 0, 1, 1], [0.1, 0.2, 0.3, 0.4, 0.8, 0.9], strict=True))], "y int, score double, tool_calls int, usd double, wall_ms double")
    r = metrics.efficiency(df, metrics.sensitivity_at_specificity(df)).first()
    assert [r.per_1k_calls, r.per_usd, r.per_minute] == pytest.approx([2.0, 10.0, 1.0])
    free = metrics.efficiency(df.withColumn("usd", F.lit(0.0)), metrics.sensitivity_at_specificity(df)).first()
    assert free.per_usd is None


def test_weighted_bootstrap_is_resampling(spark):
    p = cohort(120)
    df = spark.createDataFrame(p)
    got = {r.it: r.sensitivity for r in resample.bootstrap(df, ["score"], iterations=8, seed=3, chunk=3).collect()}
    names, rng = sorted(p.pid.unique()), np.random.default_rng(3)
    rows = {n: p[p.pid == n] for n in names}
    for it in range(8):
        s = pd.concat([rows[names[k]] for k in rng.choice(len(names), size=len(names), replace=True)])
        neg, pos = np.sort(s.score[s.y == 0]), s.score[s.y == 1]
        t = neg[min(max(math.ceil(0.96 * len(neg)), 1), len(neg)) - 1]
        assert got[it] == pytest.approx((pos > t).mean())


def test_conformal(spark):
    p = cohort(300, 5)
    df = spark.createDataFrame(p)
    q = conformal.fit(df, 0.1).first()
    pos = np.sort(1 - p.score[p.y == 1])
    assert q.q_pos == pos[math.ceil((len(pos) + 1) * 0.9) - 1]
    few = conformal.fit(df.limit(6).withColumn("y", F.col("case_id") % 2), 0.1).first()
    assert few.q_pos == math.inf
    with pytest.raises(Exception, match="no calibration rows"):
        conformal.fit(df.where("y = 1")).collect()


def test_sequential_forms_agree(spark):
    rng = np.random.default_rng(2)
    rows = [(k, f"P{k}", int(rng.random() < 0.8), float(rng.random() < 0.9), float(rng.random() < 0.7)) for k in range(300)]
    df = spark.createDataFrame(rows, "seq int, pid string, y int, cand double, champ double")
    path = sequential.wealth(sequential.payoffs(df, 0.02, order="seq"), batch_size=25)
    v = sequential.verdict(path).first()
    e = sequential.EProcess(0.02)
    positives = [(y, c, h, p) for _, p, y, c, h in rows if y == 1]
    for k in range(0, len(positives), 25):
        e.update(positives[k : k + 25])
    assert (v.n, v.accepted_at) == (e.n, e.accepted_at) and v.max_log_wealth == pytest.approx(e.max_log_wealth)
    with pytest.raises(ValueError, match="already bet"):
        e.update(positives[:1])
    with pytest.raises(ValueError):
        sequential.EProcess(0.6)


def test_false_acceptance_is_rare():
    rng, accepted = np.random.default_rng(9), 0
    for _ in range(200):
        e = sequential.EProcess(0.0, 0.05)
        for b in range(5):
            e.update([(1, float(rng.random() < 0.8), float(rng.random() < 0.8), f"{b}.{k}") for k in range(60)])
        accepted += e.accepted_at is not None
    assert accepted <= 10


def test_gate_passes_equal_arms_and_fails_worse_ones(spark):
    p = cohort(600, 1)
    df = spark.createDataFrame(p.assign(cand=p.score, champ=p.score, rerun=p.score))
    good = gate.run_gate(df, {"iterations": 30, "worst_slice_margin": 0.5}, ["site"], rerun="rerun")
    assert gate.passed(good).first().passed
    worse = df.withColumn("cand", F.rand(1)).withColumn("rerun", F.col("cand") + 1e-3)
    failed = {r.name for r in gate.run_gate(worse, {"iterations": 30}, ["site"], rerun="rerun").collect() if not r.passed}
    assert {"primary_non_inferiority", "negative_flip_rate", "determinism"} <= failed
    alone = gate.run_gate(df, champion=False)
    assert "primary_metric" in {r.name for r in alone.collect()}


def test_chain_and_tampering(spark):
    rows = [(c, k, f"body {c} {k}") for c in range(4) for k in range(5)]
    chain = events.chain(spark.createDataFrame(rows, "key int, seq int, body string"), "key", "seq", "body").cache()
    assert all(r.intact for r in events.verify_chain(chain, "key", "seq", "body").collect())
    bad = chain.withColumn("body", F.when((F.col("key") == 2) & (F.col("seq") == 3), "edited").otherwise(F.col("body")))
    assert {r.key for r in events.verify_chain(bad, "key", "seq", "body").collect() if not r.intact} == {2}
    gone = chain.where("not (key = 1 and seq = 2)")
    assert {r.key for r in events.verify_chain(gone, "key", "seq", "body").collect() if not r.intact} == {1}
    cut = chain.where("not (key = 1 and seq = 4)")
    heads = {r.key: r.head for r in events.verify_chain(chain, "key", "seq", "body").collect()}
    assert events.verify_chain(cut, "key", "seq", "body").where("key = 1").first().head != heads[1]


def test_chains_of_any_length_nulls_and_emptiness(spark):
    """A chain of 30,000 entries, far beyond a batch, beside short ones, a null key, null bodies and a clashing column."""
    import hashlib

    rows = [(1, k, f"é{k}" if k % 7 else None) for k in range(30_000)] + [(2, 0, ""), (None, 0, "a"), (None, 1, "b")]
    table = spark.createDataFrame(rows, "key int, seq int, body string").withColumn("prev_sha", F.lit("x"))
    got = events.chain(table, "key", "seq", "body")
    assert got.columns == ["key", "seq", "body", "prev_sha", "entry_sha"]
    found = {(r.key, r.seq): (r.prev_sha, r.entry_sha) for r in got.collect()}
    last, want = {}, {}
    for key, seq, body in rows:
        before = last.get(key, events.GENESIS)
        last[key] = hashlib.sha256(f"{body or ''}|{before}".encode()).hexdigest()
        want[key, seq] = before, last[key]
    assert found == want
    checked = {r.key: r for r in events.verify_chain(got, "key", "seq", "body").collect()}
    assert {k: (r.entries, r.head, r.intact) for k, r in checked.items()} == {1: (30_000, last[1], True), 2: (1, last[2], True), None: (2, last[None], True)}
    lost = got.withColumn("entry_sha", F.when(F.col("seq") != 1, F.col("entry_sha")))
    assert {r.key for r in events.verify_chain(lost, "key", "seq", "body").collect() if r.intact} == {2}
    assert events.chain(table.limit(0), "key", "seq", "body").count() == 0


def test_ledger_lines(spark, tmp_path):
    from quillon.sources import files

    ledger = events.Ledger()
    for k in range(6):
        ledger.append("tool_call", {"n": k, "who": "ü"}, f"t{k}")
    assert ledger.verify()
    (tmp_path / "l.jsonl").write_text("".join(json.dumps(e, sort_keys=True) + "\n" for e in ledger.entries))
    read = files.read_ledger(spark, str(tmp_path / "l.jsonl"))
    v = files.verify_lines(read).first()
    assert v.intact and v.entries == 6 and v["head"] == ledger.entries[-1]["entry_sha"]
    files.write_ledger(read, str(tmp_path / "out"))
    assert files.verify_lines(files.read_ledger(spark, str(tmp_path / "out"))).first().intact
    (tmp_path / "l.jsonl").write_text((tmp_path / "l.jsonl").read_text().replace('"n": 3', '"n": 4'))
    assert not files.verify_lines(files.read_ledger(spark, str(tmp_path / "l.jsonl"))).first().intact
    ledger.entries[2]["payload"]["n"] = 9
    assert not ledger.verify()


def test_bank(spark):
    e = [(0, "a", "add", "probation"), (1, "a", "merge", None), (2, "a", "confirm", None), (3, "b", "add", "confirmed"), (4, "b", "retire", None), (5, "b", "merge", None)]
    got = {r.record_id: (r.status, r.cluster_size) for r in events.bank_state(spark.createDataFrame(e, "seq int, record_id string, kind string, status string")).collect()}
    assert got == {"a": ("confirmed", 2), "b": ("retired", 2)}
    v = [("r1", 0, [1.0, 0.0, 0.0, 0.2]), ("r2", 1, [0.95, 0.05, 0.0, 0.25]), ("r3", 2, [0.0, 1.0, 0.0, 0.0]), ("r1", 3, None), ("r4", 4, [0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, k, "l", "x", "y", e) for i, k, e in v], "record_id string, seq bigint, label string, expected string, observed string, embedding array<double>")
    got = {(r.record_id, r.seq): (r.target, r.merged) for r in events.add_records(df).collect()}
    assert got == {("r1", 0): ("r1", False), ("r2", 1): ("r1", True), ("r3", 2): ("r3", False), ("r1", 3): ("r1", True), ("r4", 4): ("r4", False)}


def test_breaker(spark):
    df = spark.createDataFrame([("b", k, True) for k in range(4)], "batch string, seq int, wants boolean")
    assert [r.granted for r in events.admitted(df, 0.25, "batch").orderBy("seq").collect()] == [True, False, False, False]
    assert not any(r.granted for r in events.admitted(df, 0.0, "batch").collect())
    rng = np.random.default_rng(3)
    rows = [(None if b == 2 else f"b{b}", k, None if k % 17 == 0 else bool(rng.random() < 0.2 + 0.3 * b)) for b in range(3) for k in range(200)]
    df = spark.createDataFrame(rows, "batch string, seq int, wants boolean")
    for fraction in (0.1, 0.3, 1.0):
        want = {}
        for b in {r[0] for r in rows}:
            breaker = events.Breaker(fraction)
            for _, k, w in (r for r in rows if r[0] == b):
                breaker.seen += 1
                want[b, k] = bool(w) and breaker.admit()
        assert {(r.batch, r.seq): r.granted for r in events.admitted(df, fraction, "batch").collect()} == want


def test_memo(spark):
    log = spark.createDataFrame([("k1", 0, 60, "a"), ("k2", 1, 50, "b"), ("k1", 2, 40, "c"), ("k3", 3, 500, "d")], "key string, seq bigint, bytes bigint, result string")
    last = events.memo_load(log)
    assert {r.key: r.result for r in last.collect()} == {"k1": "c", "k2": "b", "k3": "d"}
    assert {r.key for r in events.memo_compact(last, 100).collect()} == {"k3"}
    assert {r.key for r in events.memo_compact(last.where("key <> 'k3'"), 90).collect()} == {"k1", "k2"}


def test_splits(spark):
    people = {f"P{k}": "ab"[k % 2] for k in range(21)}
    shares = {"train": 0.6, "val": 0.2, "test": 0.2}
    first = splits.seeded_splits(people, shares, 7)
    assert first == splits.seeded_splits(people, shares, 7) and set(first) == set(people)
    text = splits.manifest(first)
    assert splits.open_manifest(text) == first
    with pytest.raises(ValueError, match="hash"):
        splits.open_manifest(text.replace('"train"', '"val"', 1))
    got = splits.hash_splits(spark.createDataFrame(list(people.items()), "pid string, site string"), shares).toPandas()
    for _, g in got.groupby("site"):
        n = g.split.value_counts()
        assert all(abs(n.get(k, 0) - len(g) * v) < 1 for k, v in shares.items()) and len(g) == n.sum()
    with pytest.raises(ValueError):
        splits.hash_splits(spark.createDataFrame([("p", "s")], "pid string, site string"), {"train": 0.5})


def test_near_images_lose_none(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-(2**63), 2**63 - 1, 30)
    codes = [int(b) ^ sum(1 << int(k) for k in rng.choice(63, n, replace=False)) for b in base for n in (0, 2, 4, 6)]
    rows = [(k, "xy"[k % 2], c) for k, c in enumerate(codes)]
    got = {(r.a, r.b) for r in splits.near_images(spark.createDataFrame(rows, "case_id int, split string, ahash bigint")).collect()}
    bits = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert got == {(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if rows[a][1] != rows[b][1] and bits(codes[a], codes[b]) <= 4}


def test_students(spark):
    rng = np.random.default_rng(0)
    x = np.column_stack([np.linspace(0, 1, 201), rng.random(201)])
    y = np.where(x[:, 0] > 0.65, 0, np.where(x[:, 0] < 0.35, 1, 2))
    df = spark.createDataFrame([(k, float(a), float(b), learners.CLASSES[t], "recall" if a > 0.5 else "no_recall") for k, ((a, b), t) in enumerate(zip(x, y, strict=True))], "k int, a double, b double, truth string, two string")
    tree = learners.fit_tree(df, ["a", "b"], "truth")
    assert tree.predict(df).where("decision = truth").count() >= 0.99 * 201
    line = learners.fit_logistic(df, ["a", "b"], "two")
    assert line.predict(df).where("decision = two").count() >= 0.98 * 201
    assert line.params["weights"][2] == [0.0, 0.0, -30.0]
    assert learners.Student.from_dict(line.to_dict(), line.student_id()).student_id() == line.student_id()
    with pytest.raises(ValueError):
        learners.Student.from_dict(line.to_dict(), "0" * 12)


def test_students_by_plain_numpy(spark):
    """The tree's splits against all splits tried one by one, the logistic weights against a zero gradient."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, size=(400, 3)).astype(float)
    y = np.where(x[:, 1] + rng.normal(0, 2, 400) > 7, 0, np.where(x[:, 0] + rng.normal(0, 2, 400) < 4, 1, 2))
    df = spark.createDataFrame([(*map(float, a), learners.CLASSES[t]) for a, t in zip(x, y, strict=True)], "a double, b double, c double, decision string").repartition(3)
    counts = lambda k: np.bincount(y[k], minlength=3)

    def check(tree, rows, deep):
        if "leaf" in tree:
            assert tree["leaf"] == counts(rows).tolist()
            return
        worth = lambda m: (counts(rows[m]) ** 2).sum() / m.sum() + (counts(rows[~m]) ** 2).sum() / (~m).sum()
        tried = {(f, t): worth(x[rows, f] <= t) for f in range(3) for t in np.arange(0.5, 11) if min((x[rows, f] <= t).sum(), (x[rows, f] > t).sum()) >= 5}
        under = x[rows, tree["feature"]] <= tree["threshold"]
        assert deep < 3 and worth(under) == pytest.approx(max(tried.values()))
        check(tree["left"], rows[under], deep + 1)
        check(tree["right"], rows[~under], deep + 1)

    check(learners.fit_tree(df, ["a", "b", "c"]).params["tree"], np.arange(400), 0)
    line = learners.fit_logistic(df, ["a", "b", "c"]).params
    z = np.column_stack([(x - line["mean"]) / line["std"], np.ones(400)])
    for k, w in enumerate(line["weights"]):
        assert np.abs(z.T @ (learners.squash(z @ w) - (y == k)) + 1e-3 * np.array(w)).max() < 1e-3


def test_head_and_temperature(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 2))
    y = (rng.random(500) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1])))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(t)) for (a, b), t in zip(x, y, strict=True)], "a double, b double, y int")
    h = learners.fit_head(df, ["a", "b"])
    w, b = np.random.default_rng(0).normal(0, 0.01, 2), 0.0
    for _ in range(400):
        g = (learners.squash(x @ w + b) - y) / 500
        w, b = w - 0.5 * (x.T @ g + 1e-3 * w), b - 0.5 * g.sum()
    assert [*h.weights, h.bias] == pytest.approx([*w, b])
    assert learners.Head.from_json(h.to_json()) == h
    scored = df.withColumn("logit", 3 * (F.col("a") * 2 - F.col("b")))
    t = learners.best_temperature(scored).first()
    assert 2 < t.t < 4.5


def test_traces(spark):
    rows = [(f"c{k}", "recall", k % 5 == 0, 0.5 if k % 2 else None) for k in range(300)]
    df = spark.createDataFrame(rows, "case_id string, decision string, fallback_used boolean, case_score double")
    got = learners.load_traces(df, ["case_score"])
    assert got.count() == 240 and got.where("case_score is null").count() == 0
    with pytest.raises(ValueError, match="fewer"):
        learners.load_traces(df, ["case_score"], 241)


def disc(size=96, at=(48, 48), radius=10, high=0.9, low=0.2):
    y, x = np.mgrid[:size, :size]
    return np.where((x - at[0]) ** 2 + (y - at[1]) ** 2 <= radius**2, high, low).astype(np.float32)


def test_kernels():
    image = disc()
    boxes = kernels.propose(image)
    x0, y0, x1, y1, score = boxes[0]
    assert abs((x0 + x1) / 2 - 48) <= 10 and abs((y0 + y1) / 2 - 48) <= 10 and score > 0.5
    assert kernels.propose(np.full((64, 64), 0.5, np.float32)) == []
    y, x = np.mgrid[:96, :96]
    assert kernels.propose((0.3 + 0.2 * x / 96).astype(np.float32)) == []
    s = kernels.segment(image, (33, 33, 63, 63))
    assert s["found"] and s["aspect_ratio"] == 1.0 and s["area_mm2"] == pytest.approx(np.pi, rel=0.05)
    assert kernels.segment(image, (0, 0, 1, 1))["reason"] == "box too small"
    moved = np.roll(image, (4, -3), axis=(0, 1))
    r = kernels.register(moved, image)
    assert (r["dy"], r["dx"], r["passed"]) == (4, -3, True)
    rng = np.random.default_rng(0)
    assert not kernels.register(rng.random((64, 64)), rng.random((64, 64)))["passed"]
    assert kernels.register(image, image[:10])["reason"] == "shapes differ"
    assert kernels.compare_prior(image, image, (33, 33, 63, 63))["change"] == "stable_within_measurement_error"
    assert kernels.measure(image, (10, 20, 30, 60))["long_axis_mm"] == 4.0
    e = kernels.embed(image)
    assert len(e) == 20 and e[12:].sum() == pytest.approx(1) and kernels.embed(np.zeros((0, 0))).tolist() == [0.0] * 20
    assert len(kernels.shifted_reads(image, 9)) == len([b for k in range(5) for b in kernels.propose(np.roll(image, kernels.SHIFTS[k], axis=(0, 1)))])
    assert kernels.average_hash(image) != kernels.average_hash(disc(at=(20, 20)))


def test_blur_is_a_gaussian():
    image = np.zeros((41, 41))
    image[20, 20] = 1
    out = kernels.blur(image, 2.0)
    assert out.sum() == pytest.approx(1) and out[20, 22] / out[20, 20] == pytest.approx(np.exp(-0.5))


def test_image_pipeline(spark):
    from quillon.sources.phantom import generate

    images = generate(spark, patients=20, images=1, prevalence=0.5, size=96, seed=11).cache()
    base = kernels.detect(images)
    qc = images.select("case_id", candidates.quality_verdict(F.col("pixels")).alias("qc"))
    out = case_path.run_cases(qc, base, kernels.reads(images), kernels.detect(images, "blindspot"))
    assert out.count() == 20
    scored = out.join(images.select("case_id", F.col("label").alias("y")), "case_id").withColumn("score", F.col("case_score"))
    assert metrics.auroc(scored).first()[0] > 0.7
    s = kernels.segments(images, base)
    assert s.count() == base.count()
    z = kernels.zoom_reads(images, base)
    assert set(z.columns) >= {"width", "height", "score"}


def test_quality_verdict(spark):
    rows = [(1, [0.5] * 10), (2, [1.0] * 6 + [0.0] * 4), (3, [0.1, 0.4])]
    df = spark.createDataFrame(rows, "k int, pixels array<double>")
    assert [r[0] for r in df.orderBy("k").select(candidates.quality_verdict(F.col("pixels"))).collect()] == ["inadequate_defer", "degraded", "adequate"]


def test_json_sources(spark, tmp_path):
    from quillon.functions.canonical import content_id, dumps
    from quillon.sources import files

    (tmp_path / "atlas.json").write_text(json.dumps({"version": "v1", "entries": [{"case_id": "a", "label": 1, "embedding": [1.0]}, {"case_id": "b", "label": 0, "embedding": [2.0]}]}))
    assert [(r.pos, r.case_id) for r in files.read_entries(spark, str(tmp_path / "atlas.json"), "case_id string, label int, embedding array<double>").collect()] == [(0, "a"), (1, "b")]
    (tmp_path / "g.json").write_text(json.dumps({"y": [0, 1], "s": [0.1, 0.2]}))
    assert files.read_parallel(spark, str(tmp_path / "g.json"), ["y", "s"], {"y": "int", "s": "double"}).count() == 2
    (tmp_path / "h.json").write_text(json.dumps({"y": [0, 1], "s": [0.1]}))
    with pytest.raises(Exception, match="differ in length"):
        files.read_parallel(spark, str(tmp_path / "h.json"), ["y", "s"], {"y": "int", "s": "double"}).collect()
    text = dumps({"b": 1, "a": "é"}, True)
    name = content_id({"b": 1, "a": "é"})
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / f"{name}.json").write_text(text)
    assert files.read_addressed(spark, str(tmp_path / "p")).first().text == text
    (tmp_path / "p" / f"{name}.json").write_text(text + " ")
    with pytest.raises(Exception, match="does not match"):
        files.read_addressed(spark, str(tmp_path / "p")).collect()
    np.save(tmp_path / "img.npy", disc(32))
    r = files.read_arrays(spark, str(tmp_path)).first()
    assert (r.handle, r.h, r.w) == ("img", 32, 32)
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "p1.json").write_text(json.dumps({"policy_id": "p1", "ts": "t", "results": {"x": True, "y": False}}))
    assert {(x.record_id, x.passed) for x in files.read_replays(spark, str(tmp_path / "r")).collect()} == {("x", True), ("y", False)}


def test_compact_request_leaves_nulls_out(spark):
    cases = spark.createDataFrame([("c", "adequate", 0.51239, 0.2)], "case_id string, qc string, case_score double, disagreement double")
    cand = spark.createDataFrame([("c", f"k{n}", n / 10, None) for n in range(10)], "case_id string, candidate_id string, score double, veto_reason string")
    r = json.loads(candidates.compact_request(cases, cand).first().request)
    assert r["omitted_candidates"] == 2 and r["max_omitted_score"] == 0.1 and [x["candidate_id"] for x in r["candidates"]] == [f"k{n}" for n in range(9, 1, -1)]
    assert "veto_reason" not in r["candidates"][0] and r["consistency"]["case_score"] == 0.512


def test_quality_verdict_edges(spark):
    rows = [(1, [0.1, 0.9]), (2, [0.5, 0.52]), (3, [0.0, 1.0, 1.0]), (4, []), (5, None), (6, [None, 0.5]), (7, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id int, pixels array<double>").select("id", candidates.quality_verdict(F.col("pixels")).alias("qc"))
    assert {r.id: r.qc for r in df.collect()} == {1: "adequate", 2: "inadequate_defer", 3: "degraded", 4: "inadequate_defer", 5: "inadequate_defer", 6: "inadequate_defer", 7: "adequate"}


def test_valid_records_and_topics(spark):
    rows = [(1, "a", "b", "report", "probation"), (1, "a", "a", "report", "probation"), (2, "a", "b", "report", "probation"), (0, "a", "b", "eval_miss", "confirmed"), (0, "a", "b", "eval_miss", "probation"), (None, "a", "b", "report", "x"), (1, None, "b", "report", "x"), (1, "a", "b", None, "confirmed")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, label int, expected string, observed string, source string, status string")
    got = {r.k: r.ok for r in df.select("k", events.valid_record(*(F.col(c) for c in ("label", "expected", "observed", "source", "status"))).alias("ok")).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False, 4: True, 5: False, 6: False, 7: False}
    corpus = spark.createDataFrame([(1, "Mass Margins", None), (2, "calcification", "MASS"), (3, None, None)], "id int, topic string, note string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(events.topic_entries(corpus, "mAsS")) == [1] and ids(events.topic_entries(corpus, "mass", "topic", "note")) == [1, 2] and ids(events.topic_entries(corpus, "")) == [1, 2]


def test_paired_outcomes_must_match(spark):
    arm = lambda *rows: spark.createDataFrame(rows, "case_id int, score double").withColumn("y", F.lit(1))
    got = sequential.paired(arm((1, 0.5), (2, None)), arm((2, 0.1), (1, 0.2)), keep=("y",))
    assert sorted((r.case_id, r.y, r.cand, r.champ) for r in got.collect()) == [(1, 1, 0.5, 0.2), (2, 1, None, 0.1)]
    for a, b in (([(1, 0.5)], [(2, 0.5)]), ([(1, 0.5), (1, 0.5)], [(1, 0.5)]), ([(None, 0.5)], [(None, 0.5)]), ([(1, 0.1), (2, 0.1)], [(1, 0.1)])):
        with pytest.raises(Exception, match="once in each arm"):
            sequential.paired(arm(*a), arm(*b)).collect()
    assert sequential.paired(arm((1, 0.5)).limit(0), arm((1, 0.5)).limit(0)).count() == 0


def test_labelled_traces(spark):
    traces = spark.createDataFrame([(1, "t"), (1, "u"), (2, "v"), (None, "w"), (3, "x")], "case_id int, trace string").withColumn("label", F.lit("old"))
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 1), (9, 0)], "case_id int, label int")
    assert sorted((r.case_id, r.trace, r.label) for r in learners.labelled(traces, labels).collect()) == [(1, "t", 1), (1, "u", 1)]
    with pytest.raises(Exception, match="labels differ"):
        learners.labelled(traces, labels.unionByName(spark.createDataFrame([(1, 0)], "case_id int, label int"))).collect()
