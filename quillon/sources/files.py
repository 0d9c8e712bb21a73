"""JSON and array files as tables, with checks of content hashes on the way in."""

from __future__ import annotations

import io
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.canonical import content_id

LEDGER = "ts string, kind string, payload string, prev_sha string, entry_sha string"
TRACE = "case_id string, decision string, fallback_used boolean, features map<string,double>"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, line) of text files: seq is a line's place in its file, from 0. Blank lines count and are left out.

    Files are read in splits, as many tasks as they need. A split's rows come one after another, so a line's place is its
    distance from the first one of its split, and the lines of the splits before it; only those two numbers a split are added up.
    """
    place = F.monotonically_increasing_id()
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), place.alias("at"), F.col("value").alias("line"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = raw.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    splits = splits.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return raw.join(splits, ["file", "block"]).where("length(line) > 0").select("file", (F.col("start") + F.col("at") - F.col("first")).alias("seq"), "line")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as (seq, line, ts, kind, payload, prev_sha, entry_sha); seq is the place in its file, payload and line are exact text."""
    v = F.parse_json("line")
    return read_lines(spark, path).select("seq", "line", *(F.variant_get(v, f"$.{k}", "string").alias(k) for k in ("ts", "kind", "payload", "prev_sha", "entry_sha")))


def verify_lines(ledger: DataFrame) -> DataFrame:
    """(entries, head, intact): each line's canonical body must give its hash, and link to the line before."""

    @F.pandas_udf("string")
    def body_sha(line: pd.Series) -> pd.Series:
        import hashlib

        from quillon.functions.canonical import dumps

        return line.map(lambda x: hashlib.sha256(dumps({k: v for k, v in json.loads(x).items() if k != "entry_sha"}).encode()).hexdigest())

    before = ledger.select((F.col("seq") + 1).alias("seq"), F.col("entry_sha").alias("_b"))
    j = ledger.join(before, "seq", "left").withColumn("_ok", (body_sha("line") == F.col("entry_sha")) & (F.col("prev_sha") == F.coalesce("_b", F.lit("0" * 64))))
    return j.agg(F.count("*").alias("entries"), F.max_by("entry_sha", "seq").alias("head"), F.every("_ok").alias("intact"))


def write_ledger(ledger: DataFrame, path: str) -> None:
    """Lines in order of seq. A ledger has a single writer, so one file."""
    ledger.orderBy("seq").select("line").coalesce(1).write.mode("append").text(path)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Traces under a fixed schema; a line that breaks it fails the read, blank lines don't count."""
    return spark.read.schema(TRACE).option("mode", "FAILFAST").json(path)


def read_entries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the `entries` array of a JSON document, with their position: atlases and criteria."""
    doc = spark.read.schema(f"version string, entries array<struct<{schema}>>").option("multiLine", True).json(path)
    return doc.select(F.posexplode("entries").alias("pos", "e")).select("pos", "e.*")


def read_parallel(spark: SparkSession, path: str, arrays: list[str], kinds: dict[str, str]) -> DataFrame:
    """A JSON document of parallel arrays as one row per place; arrays of unequal length fail."""
    doc = spark.read.schema(", ".join(f"{a} array<{kinds[a]}>" for a in arrays)).option("multiLine", True).json(path)
    same = F.expr(" and ".join(f"size({arrays[0]}) = size({a})" for a in arrays))
    doc = doc.where(F.when(same, True).otherwise(F.raise_error(F.lit("arrays differ in length")).cast("boolean")))
    return doc.select(F.posexplode(F.arrays_zip(*arrays)).alias("pos", "e")).select("pos", "e.*")


def read_replays(spark: SparkSession, path: str) -> DataFrame:
    """(policy_id, ts, record_id, passed) of all replay files of a folder."""
    docs = spark.read.schema("policy_id string, ts string, results map<string,boolean>").option("multiLine", True).json(path)
    return docs.select("policy_id", "ts", F.explode("results").alias("record_id", "passed"))


def read_addressed(spark: SparkSession, path: str, size: int = 12) -> DataFrame:
    """(id, text) of files named by the hash of their text; a file whose text has another hash fails."""
    return _addressed(spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([0-9a-f]+)\.\w+$", 1).alias("id"), F.col("value").alias("text")), size)


def read_store(spark: SparkSession, path: str, size: int = 12) -> DataFrame:
    """(id, text) of a table that write_store made; an edited row fails."""
    return _addressed(spark.read.schema("id string, text string").parquet(path), size)


def _addressed(raw: DataFrame, size: int) -> DataFrame:
    good = F.substring(F.sha2("text", 256), 1, size) == F.col("id")
    return raw.where(F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("content does not match its id: "), F.col("id"))).cast("boolean")))


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(handle, h, w, pixels, sha256) of .npy files, read by Spark so that any store serves; two-dimensional arrays only."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select(F.regexp_extract("path", r"([^/]+)\.npy$", 1).alias("handle"), "content")

    def load(batches):
        import hashlib

        for b in batches:
            a = [np.load(io.BytesIO(x), allow_pickle=False) for x in b["content"]]
            yield pd.DataFrame({"handle": b["handle"], "h": [x.shape[0] for x in a], "w": [x.shape[1] for x in a], "pixels": [x.astype(np.float32).ravel().tolist() for x in a], "sha256": [hashlib.sha256(np.ascontiguousarray(x).tobytes()).hexdigest() for x in a]})

    return files.mapInPandas(load, "handle string, h int, w int, pixels array<float>, sha256 string")


def describe(artifacts: DataFrame) -> DataFrame:
    """Artifacts without their pixels, by handle."""
    return artifacts.select(*(c for c in artifacts.columns if c not in ("pixels", "content"))).orderBy("handle")


def read_rules(path: str) -> dict:
    """Gate rules from YAML, or from JSON where no YAML reader is installed, as the flat bounds the gate takes."""
    text = open(path, encoding="utf-8").read()
    try:
        import yaml

        raw = yaml.safe_load(text)
    except ImportError:
        raw = json.loads(text)
    names = {
        ("primary", "specificity"): "specificity", ("primary", "non_inferiority_margin"): "margin", ("primary", "bootstrap_iterations"): "iterations", ("primary", "alpha"): "alpha",
        ("subgroup_floors", "worst_slice_margin"): "worst_slice_margin", ("subgroup_floors", "min_slice_size"): "min_slice_size", ("calibration", "max_ece_adaptive"): "max_ece", ("regression", "max_negative_flip_rate"): "max_flip_rate",
        ("determinism", "required_agreement"): "required_agreement", ("failure_bank", "max_confirmed_regressions"): "max_regressions", ("efficiency", "max_cost_ratio_vs_champion"): "max_cost_ratio",
        ("efficiency", "max_tool_calls_ratio"): "max_call_ratio", ("sequential", "alpha"): "sequential_alpha",
    }
    return {name: raw[a][b] for (a, b), name in names.items() if b in raw.get(a, {})}


# -- sinks ------------------------------------------------------------------------


def append_json(df: DataFrame, path: str) -> None:
    """Cost rows and traces: JSON lines, appended."""
    df.write.mode("append").json(path)


def write_artifacts(artifacts: DataFrame, path: str) -> DataFrame:
    """Append artifacts under handles made from their content, and give (handle, sha256); known content is not written again."""
    spark = artifacts.sparkSession
    sha = F.sha2(F.concat(F.to_json(F.struct("h", "w")).cast("binary"), F.to_json("pixels").cast("binary")), 256)
    new = artifacts.withColumn("sha256", sha).withColumn("handle", F.concat(F.lit("art:"), F.substring("sha256", 1, 12))).dropDuplicates(["sha256"])
    try:
        new = new.join(spark.read.parquet(path).select("sha256"), "sha256", "left_anti")
    except Exception as error:  # the first write finds no table
        if "PATH_NOT_FOUND" not in str(error):
            raise
    new.write.mode("append").parquet(path)
    return artifacts.withColumn("sha256", sha).select(F.concat(F.lit("art:"), F.substring("sha256", 1, 12)).alias("handle"), "sha256")


def write_store(texts: DataFrame, path: str, size: int = 12) -> DataFrame:
    """Append policies, prompts or students (text) under the hash of their text, and give (id, text); known ones are not written again.

    Null texts are left out. One writer at a time: two at once may both append the same text.
    """
    spark = texts.sparkSession
    named = texts.where("text is not null").select(F.substring(F.sha2("text", 256), 1, size).alias("id"), "text").distinct()
    try:
        new = named.join(read_store(spark, path, size).select("id"), "id", "left_anti")
    except Exception as error:  # the first write finds no table
        if "PATH_NOT_FOUND" not in str(error):
            raise
        new = named
    new.write.mode("append").parquet(path)
    return named


def derived_versions(spark: SparkSession, parameters: dict[str, object], data: dict[str, str | None], fixed: tuple[str, ...] = ("crop_region", "segment", "measure")) -> dict[str, str]:
    """A version of each tool from what decides its results: its parameters, the bytes of its data file, or a constant of the code.

    Data that is not there is "absent"; a folder counts as the hashes of its files. Files are hashed where they are read
    (2 GB each at most), and only hashes reach the driver.
    """
    out = {tool: content_id(value, compact=False) for tool, value in parameters.items()} | dict.fromkeys(fixed, "v1")
    for tool, path in data.items():
        try:
            found = [r[0] for r in spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).orderBy("h").collect()] if path else []
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            found = []
        out[tool] = "absent" if not found else found[0][:12] if len(found) == 1 else content_id(found)
    return out


def write_replays(results: DataFrame, path: str) -> None:
    """Pass vectors by policy: those of the policies in results are replaced, others stay."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("policy_id").parquet(path)
