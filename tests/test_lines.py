"""Ordered reads of text files in splits."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quillon.sources.files import read_ledger, read_lines


def test_a_large_file_is_read_in_splits_and_in_order(spark, tmp_path):
    n = 120_000
    (tmp_path / "in").mkdir()
    with open(tmp_path / "in/a.jsonl", "w") as f:
        f.writelines("\n" if k % 1000 == 7 else json.dumps({"ts": str(k), "kind": "é" * (k % 5), "payload": {"n": k, "text": "x" * (k * 7919 % 300)}}) + "\n" for k in range(n))
    (tmp_path / "in/b.jsonl").write_text("first\r\n\nlast without an end")
    (tmp_path / "in/c.jsonl").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        lines = read_lines(spark, str(tmp_path / "in"))
        assert spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions() > 20
        own = lines.where(F.col("file").endswith("a.jsonl"))
        wrong = own.where(F.get_json_object("line", "$.ts").cast("bigint") != F.col("seq"))
        assert own.count() == n - n // 1000 and wrong.count() == 0 and own.select("seq").distinct().count() == own.count()
        assert sorted((r.seq, r.line) for r in lines.where(F.col("file").endswith("b.jsonl")).collect()) == [(0, "first\r"), (2, "last without an end")]
        ledger = read_ledger(spark, str(tmp_path / "in/a.jsonl"))
        assert ledger.where(F.col("ts").cast("bigint") != F.col("seq")).count() == 0 and ledger.where("seq = 119999").first().kind == "é" * 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
