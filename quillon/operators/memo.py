"""Addresses of tool calls by the content of their arguments, and a memo table with versions."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.canonical import dumps
from quillon.operators.events import memo_compact, memo_load
from quillon.plans.written import written
from quillon.sources.snapshots import Snapshots, Version

# The tools whose results may be used again, in other runs or in the same run alone, and how a handle is told and replaced.
CROSS_RUN = ("lookup_criteria", "measure", "retrieve_similar", "run_detector")
IN_RUN = ("crop_region", "segment")
HANDLE, CONTENT = "art:", "__artifact_sha256__"
#: Decimals that a number of the arguments keeps.
DIGITS = 12

#: A JSON string that begins as a handle does; some are keys or unknown, which the walk over the arguments tells.
_HANDLES = r'"(art:(?:[^"\\]|\\.)*)"'


def resolve(value: Any, known: dict[str, str]) -> Any:
    """value with each handle as the hash of its content and numbers cut to DIGITS; a KeyError for an unknown handle."""
    if isinstance(value, str) and value.startswith(HANDLE):
        return {CONTENT: known[value]}
    if isinstance(value, dict):
        return {k: resolve(v, known) for k, v in value.items()}
    if isinstance(value, list):
        return [resolve(v, known) for v in value]
    return round(value, DIGITS) if isinstance(value, float) else value


def scope(tool: Column) -> Column:
    """cross, inrun, or null for a tool that is never memoised."""
    return F.when(tool.isin(*CROSS_RUN), "cross").when(tool.isin(*IN_RUN), "inrun")


def call_keys(calls: DataFrame, artifacts: DataFrame, versions: dict[str, str] | None = None, run: str = "run", at_once: bool = False) -> DataFrame:
    """calls (tool, arguments, run, ...) with key: the address of a call by its tool, the tool's version and what its arguments hold.

    arguments is a JSON object of any depth. Every handle in it counts as the hash that artifacts (handle, sha256) has for it, so
    equal content has one address whatever its handle. An in-run tool's address also names the run (the column run; null counts as
    ""). A call has no address (null) if its tool is never memoised, if it has a handle that artifacts lacks, or if its
    arguments are null or no JSON. Of several hashes of a handle the least counts. Calls with equal arguments are resolved once.
    With at_once these are resolved now and stored, so that the planner knows their size and moves no calls where they are few.
    """
    versions = versions or {}
    distinct = calls.where(scope(F.col("tool")).isNotNull() & F.col("arguments").isNotNull()).select("tool", "arguments").distinct()
    asked = distinct.select("arguments", F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(_HANDLES), F.lit(1)))).alias("raw")).distinct()
    asked = asked.withColumn("handle", F.get_json_object(F.concat(F.lit('{"v":"'), F.col("raw"), F.lit('"}')), "$.v"))
    hashes = artifacts.groupBy("handle").agg(F.min("sha256").alias("sha256"))
    found = asked.join(hashes, "handle").groupBy("arguments").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("handle", "sha256")))).alias("known"))

    @F.pandas_udf("string")
    def text(tool: pd.Series, arguments: pd.Series, known: pd.Series) -> pd.Series:
        def one(name: str, raw: str, hashes: dict[str, str] | None) -> str | None:
            try:
                return dumps({"tool": name, "version": versions.get(name, ""), "kwargs": resolve(json.loads(raw), dict(hashes or {}))}, compact=True)
            except (KeyError, ValueError, RecursionError):
                return None

        return pd.Series([one(*x) for x in zip(tool, arguments, known, strict=True)], dtype=object)

    keyed = distinct.join(found, "arguments", "left").select("tool", "arguments", F.sha2(text("tool", "arguments", "known"), 256).alias("_sha"))
    keyed = written(keyed, "keys") if at_once else keyed
    out = calls.drop("key").join(keyed, ["tool", "arguments"], "left")
    space = F.when(scope(F.col("tool")) == "inrun", F.concat(F.lit("inrun:"), F.coalesce(F.col(run).cast("string"), F.lit("")), F.lit(":"))).otherwise("cross:")
    return out.select(*(c for c in calls.columns if c != "key"), F.concat(space, F.col("_sha")).alias("key"))


class Memo:
    """Results (key, seq, result, bytes) in a table with versions: puts append, compaction replaces, readers keep their version."""

    def __init__(self, table: Snapshots, cap: int = 200 << 20) -> None:
        self.table, self.cap = table, cap

    def put(self, results: DataFrame) -> Version:
        """Store results (key, seq, result); seq orders writes over all puts. Keys of one run and null keys are not stored."""
        new = results.where(F.col("key").startswith("cross:")).select("key", F.col("seq").cast("bigint").alias("seq"), "result", (F.octet_length("key") + F.coalesce(F.octet_length("result"), F.lit(0))).cast("bigint").alias("bytes"))
        return self.table.append(new)

    def load(self, version: int | None = None) -> DataFrame:
        """The last write of each key."""
        return memo_load(self.table.read(version))

    def compact(self) -> Version:
        """Keep the most recently written keys whose sizes sum to cap at most, the newest always, one row each."""
        return self.table.replace(lambda rows: memo_compact(memo_load(rows), self.cap))
