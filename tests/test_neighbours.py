"""Neighbour search behind the ball index, and order-dependent clustering in rounds, against loops over all pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.operators import leaders, neighbours


def clustered(n, d, clusters, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(clusters, d))[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, d))


def frame(spark, ids, vectors, name, more=""):
    rows = pd.DataFrame({name: ids, "embedding": [None if v is None else [None if c is None else float(c) for c in v] for v in vectors]})
    schema = f"{name} bigint, embedding array<double>"
    return spark.createDataFrame([tuple(x) for x in rows.itertuples(index=False)], schema).selectExpr("*", *more.split(";")[: bool(more)]).repartition(5)


def closest(queries, atlas, k, digits, others=False):
    out = set()
    for qid, q in queries:
        d = sorted((round(float(np.sqrt(((np.asarray(v) - np.asarray(q)) ** 2).sum())), digits), i) for i, v in atlas if len(v) == len(q) and not (others and i == qid))
        out |= {(qid, i, r) for r, (_, i) in enumerate(d[:k], 1)}
    return out


@pytest.mark.parametrize("size,pivots", [(4096, 64), (50, 8), (7, 1)])
def test_nearest_is_exact(spark, size, pivots):
    x = clustered(900, 6, 12, 1)
    x[300:600] = x[0]  # a third of all rows at one place
    atlas, queries = list(enumerate(x)), [(k, x[k]) for k in range(0, 900, 45)] + [(5000, np.zeros(6)), (5001, x[0] + 10)]
    make = lambda rows, name: frame(spark, *zip(*rows, strict=True), name)
    for others in (False, True):
        got = neighbours.nearest(make(queries, "query_id"), make(atlas, "atlas_id"), 5, 4, others, pivots, size)
        assert {tuple(r) for r in got.collect()} == closest(queries, atlas, 5, 4, others)


def test_shells_out_of_reach_are_not_read(spark):
    x = clustered(20_000, 16, 40, 2)
    atlas, queries = frame(spark, range(20_000), x, "atlas_id"), frame(spark, range(0, 20_000, 500), x[::500], "query_id")
    index = neighbours.build(atlas, "atlas_id", size=256)
    chunks = index.cells.count()
    asked = neighbours.ask(queries, index, "query_id")
    fifth = {q: sorted(np.sqrt(((x - x[q]) ** 2).sum(axis=1)))[4] for q in range(0, 20_000, 500)}
    bound = spark.createDataFrame([(q, float(d)) for q, d in fifth.items()], "id bigint, bound double")
    visits = neighbours.chunks(neighbours.reach(asked.join(bound, "id"), index, F.col("bound")))
    share = visits.count() / (chunks * len(fifth))
    assert share < 0.15, share
    got = neighbours.search(queries, index, 5).select("query_id", "atlas_id", "rank")
    assert {tuple(r) for r in got.collect()} == closest([(q, x[q]) for q in fifth], list(enumerate(x)), 5, 4)


def test_nearest_edges(spark):
    odd = [(1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [0.0, 1.0]), (5, [0.0, 1.0]), (6, [0.0, 1.0, 2.0]), (None, [0.0, 1.0]), (7, [float("inf"), 0.0]), (8, [0.0, 0.0])]
    df = spark.createDataFrame(odd, "atlas_id bigint, embedding array<double>").withColumn("rank", F.lit("mine"))
    q = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [1.0]), (None, [0.0, 1.0, 2.0])], "query_id bigint, embedding array<double>")
    got = sorted((tuple(r) for r in neighbours.nearest(q, df, 9).collect()), key=str)
    assert got == sorted([(1, None, 1), (1, 5, 2), (1, 5, 3), (1, 8, 4), (None, 6, 1)], key=str)
    assert neighbours.nearest(q, df.limit(0), 3).count() == neighbours.nearest(q.limit(0), df, 3).count() == 0


@pytest.mark.parametrize("size,pivots", [(4096, 64), (30, 5)])
def test_most_alike_is_exact(spark, size, pivots):
    x, rng = clustered(500, 5, 9, 3, 0.3), np.random.default_rng(0)
    x[100:250] = x[7]
    x[250:260] = 0
    types = rng.integers(0, 3, 500)
    types[100:300] = 1
    rows = [(k, x[k].tolist(), None if t == 2 else int(t)) for k, t in enumerate(types)]
    df = spark.createDataFrame(rows, "record_id bigint, embedding array<double>, label int").repartition(4)
    got = neighbours.most_alike(df.withColumnRenamed("record_id", "new_id"), df, ["label"], 0.9, True, pivots, size)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    want = {}
    for k in range(500):
        near = [(float((x[k] * x[j]).sum() / (np.sqrt((x[k] ** 2).sum()) * np.sqrt((x[j] ** 2).sum()))), j) for j in np.flatnonzero((unit @ unit[k] > 0.89) & (types == types[k])) if j != k]
        near = [p for p in near if p[0] >= 0.9]
        if near:
            want[k] = max(near)
    assert {r.new_id: (r.record_id, r.cos) for r in got.collect()} == {k: (j, c) for k, (c, j) in want.items()}


def folded(rows, least):
    """The reports one by one: {ord: (target, merged)}."""
    out, known = {}, {}
    for k, (_, rid, v, kind) in enumerate(rows):
        ids, vectors = known.setdefault(kind, ([], []))
        fine = v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)
        target = rid if rid in ids else None
        if target is None and fine:
            near = [(float(c), i) for i, u in zip(ids, vectors, strict=True) if u is not None and len(u) == len(v) and (c := np.dot(u, v) / (np.linalg.norm(u) * np.linalg.norm(v))) >= least]
            target = max(near)[1] if near else None
        if target is None:
            ids.append(rid)
            vectors.append(v if fine else None)
        out[k] = (target or rid, target is not None)
    return out


@pytest.mark.parametrize("fold,size,pivots", [(0, 20, 4), (2000, 4096, 64), (60, 50, 8)])
def test_leaders_small(spark, fold, size, pivots):
    x, rng = clustered(400, 4, 15, 5, 0.35), np.random.default_rng(1)
    x[50:150] = x[3]
    rows = [(k, f"r{rng.integers(0, 300):03}", x[k].tolist(), "ab"[k % 7 == 0]) for k in range(400)]
    rows += [(400, "n1", None, "a"), (401, "n1", None, "a"), (402, "n2", [0.0] * 4, "a"), (403, "n3", [1.0, 2.0], None), (404, "n4", [1.1, 2.0], None), (405, "r003", x[3].tolist(), None), (406, "n5", [1.0, float("nan"), 1.0, 1.0], "a")]
    df = spark.createDataFrame(rows, "seq bigint, record_id string, embedding array<double>, label string").withColumns({"expected": F.lit("recall"), "observed": F.lit(None).cast("string"), "merged": F.lit("mine")})
    got = {r.seq: (r.target, r.merged) for r in leaders.add_records(df.repartition(6), 0.85, fold, pivots, size).collect()}
    assert got == folded(rows, 0.85)
    assert leaders.add_records(df.limit(0)).count() == 0


def test_leaders_of_one_large_type(spark):
    """100,000 reports of one type, a third of them copies of one report, against a fold with a matrix of leaders."""
    n, least = 100_000, 0.85
    x = clustered(n, 12, 400, 6, 0.25)
    x[np.random.default_rng(2).permutation(n)[: n // 3]] = x[11]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    starts, target = [], np.zeros(n, np.int64)
    held = np.zeros((0, 12))
    for k in range(n):
        c = held @ unit[k]
        if len(starts) and c.max() >= least:
            best = np.flatnonzero(c >= c.max() - 1e-12)
            target[k] = max(starts[i] for i in best)
        else:
            starts.append(k)
            held = np.vstack([held, unit[k]])
            target[k] = k
    lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 12).cast(pa.list_(pa.float64()))
    df = spark.createDataFrame(pa.table({"seq": np.arange(n), "embedding": lists})).selectExpr("seq", "format_string('r%06d', seq) record_id", "embedding", "'a' label", "'b' expected", "'c' observed")
    got = leaders.add_records(df.repartition(8)).toPandas().sort_values("seq")
    assert (got.merged.to_numpy() == (target != np.arange(n))).all()
    assert (got.target.str[1:].astype(int).to_numpy() == target).mean() == 1.0
