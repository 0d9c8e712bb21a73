"""Streams give what batches give."""

from __future__ import annotations

import numpy as np
import pytest

from quillon.operators.sequential import EProcess
from quillon.streaming import eprocess


SCHEMA = "trial string, seq bigint, pid string, y int, cand double, champ double"


@pytest.fixture
def keyed(spark):
    name, value = next(iter(eprocess.STORE.items()))
    spark.conf.set(name, value)
    yield spark
    spark.conf.unset(name)


def _run(spark, tmp_path, until=None, **options):
    """What a query emits over all that is there; with until, which ends it, of one that goes on for its timers."""
    import time

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in" / "*"))
    found = []
    q = eprocess.test_stream(stream, **options).writeStream.outputMode("update").foreachBatch(lambda df, k: found.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c"))
    if until is None:
        q.trigger(availableNow=True).start().awaitTermination(100)
        return found
    q = q.trigger(processingTime="100 milliseconds").start()
    begun = time.time()
    while not until(found) and time.time() - begun < 60:
        time.sleep(0.2)
    q.stop()
    return found


def test_eprocess_stream_over_ten_batches_and_a_restart(keyed, tmp_path):
    """Two trials; six micro-batches, then four more by a new query from the same checkpoint. Repeated clusters are refused across the restart."""
    rng = np.random.default_rng(6)
    tests, refused = {"t": EProcess(0.02), "u": EProcess(0.02)}, {"t": 0, "u": 0}
    got = []
    for k in range(10):
        part = [("tu"[i % 2], 100 * k + i, f"P{100 * k + i // 4}", int(i % 7 > 0), float(rng.random() < 0.95), float(rng.random() < 0.6)) for i in range(60)]
        again = [("t", 100 * k + 98, "P200", 1, 1.0, 0.0), ("u", 100 * k + 99, None, 1, 1.0, 0.0)] if k in (3, 7) else []
        keyed.createDataFrame(part + again, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k:02}"))
        for t, e in tests.items():
            e.update([(y, c, h, p) for trial, _, p, y, c, h in part if trial == t])
            refused[t] += len(again) // 2 * (t == "t")
        if k in (5, 9):
            got += _run(keyed, tmp_path)
    assert len(got) == 20
    last = {r.trial: r for r in got}
    for t, e in tests.items():
        r = last[t]
        assert (r.n, r.accepted_at, r.refused, r.closed) == (e.n, e.accepted_at, refused[t], False)
        assert abs(r.log_wealth - e.log_wealth) < 1e-9 and abs(r.max_log_wealth - e.max_log_wealth) < 1e-9
    assert tests["t"].accepted_at


def test_an_idle_trial_closes(keyed, tmp_path):
    """Its result stays, its clusters go, and what comes later is refused, also by a query that starts again."""
    put = lambda k: keyed.createDataFrame([("t", k, f"P{k}", 1, 1.0, 0.0)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    put(0)
    got = _run(keyed, tmp_path, lambda found: any(r.closed for r in found), idle=50)
    assert (got[-1].n, got[-1].refused, got[-1].closed) == (1, 0, True)
    put(1)
    got = _run(keyed, tmp_path, lambda found: any(r.refused for r in found), idle=50)
    assert (got[-1].n, got[-1].refused, got[-1].closed) == (1, 1, True)


def test_state_needs_the_store(spark):
    with pytest.raises(ValueError, match="RocksDB"):
        eprocess.test_stream(spark.createDataFrame([], SCHEMA))


def test_ingest_and_windows(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        eprocess.ingest(stream, str(tmp_path / "out"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()
    costs = stream.selectExpr("ts", "event_type lane", "value usd")
    q = eprocess.windowed_costs(costs).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").groupBy().sum("n").first()[0] == events.count()
    first = eprocess.first_outcomes(stream.selectExpr("ts", "event_type trial", "cast(user_id as string) pid"), late="3650 days")
    q = first.writeStream.format("memory").queryName("f").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("f").count() == events.select("event_type", "user_id").distinct().count()
