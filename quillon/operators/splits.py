"""Patient splits, leakage, balanced samples and neighbours."""

from __future__ import annotations

import json
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.canonical import content_id, dumps
from quillon.functions.expr import hamming
from quillon.operators.neighbours import nearest as nearest
from quillon.plans.written import written

SPLITS = ("train", "val", "test", "sealed")


def hash_splits(patients: DataFrame, fractions: dict[str, float], pid: str = "pid", site: str = "site") -> DataFrame:
    """(pid, site, split): shares of each site by largest remainder, patients in order of the MD5 of their id."""
    if abs(sum(fractions.values()) - 1) > 1e-9:
        raise ValueError("fractions must sum to 1")
    p = patients.select(pid, site).distinct()
    w = Window.partitionBy(site)
    p = p.withColumn("rn", F.row_number().over(w.orderBy(F.md5(F.col(pid).cast("string")), pid))).withColumn("n", F.count("*").over(w))
    names = list(fractions)
    exact = {k: F.col("n") * F.lit(v) for k, v in fractions.items()}
    rest = F.col("n") - sum(F.floor(x) for x in exact.values())
    # an extra place for the largest fractional parts; ties in the order given
    ahead = {k: sum(F.when((exact[o] - F.floor(exact[o]) > exact[k] - F.floor(exact[k])) | ((exact[o] - F.floor(exact[o]) == exact[k] - F.floor(exact[k])) & F.lit(names.index(o) < names.index(k))), 1).otherwise(0) for o in names if o != k) + F.lit(0) for k in names}
    counts = {k: F.floor(exact[k]) + F.when(ahead[k] < rest, 1).otherwise(0) for k in names}
    split, upto = None, F.lit(0)
    for k in sorted(names):
        upto = upto + counts[k]
        split = F.when(F.col("rn") <= upto, k) if split is None else split.when(F.col("rn") <= upto, k)
    return p.select(pid, site, split.alias("split"))


def seeded_splits(patients: dict[str, str], fractions: dict[str, float], seed: int, order: tuple[str, ...] = SPLITS) -> dict[str, str]:
    """patient -> split with a seeded shuffle of each site, on the driver: for manifests that must match a seed exactly."""
    sites: dict[str, list[str]] = {}
    for pid, site in patients.items():
        sites.setdefault(site, []).append(pid)
    rng, out = random.Random(seed), {}
    for site in sorted(sites):
        ids = sorted(sites[site])
        rng.shuffle(ids)
        count = {k: int(len(ids) * v) for k, v in fractions.items()}
        for k in sorted(fractions, key=lambda k: len(ids) * fractions[k] % 1, reverse=True)[: len(ids) - sum(count.values())]:
            count[k] += 1
        labels = [k for k in order for _ in range(count.get(k, 0))]
        out |= dict(zip(ids, labels, strict=True))
    return out


def manifest(assignment: dict[str, str], version: str = "v1") -> str:
    """A manifest's JSON with its own hash."""
    return dumps({"version": version, "assignment": assignment, "sha256": content_id({"version": version, "assignment": assignment}, 64, False)})


def open_manifest(text: str) -> dict[str, str]:
    raw = json.loads(text)
    if content_id({"version": raw["version"], "assignment": raw["assignment"]}, 64, False) != raw["sha256"]:
        raise ValueError("split manifest does not match its hash")
    return raw["assignment"]


def with_split(cases: DataFrame, assignment: DataFrame, pid: str = "pid") -> DataFrame:
    return cases.join(assignment.select(pid, "split"), pid, "left").withColumn("split", F.coalesce("split", F.lit("unassigned")))


def leaking_patients(cases: DataFrame, pid: str = "pid") -> DataFrame:
    """(pid, splits): patients whose cases lie in more than one split, or in none."""
    g = cases.groupBy(pid).agg(F.sort_array(F.collect_set("split")).alias("splits"))
    return g.where((F.size("splits") > 1) | F.array_contains("splits", "unassigned"))


#: Distinct hashes of a block: two blocks are compared as one matrix, some rows at a time.
BLOCK, AT_ONCE = 4096, 64
#: Pairs of blocks that a task meets.
PAIRS = 256
#: Bands narrower than this many bits leave so many pairs that comparing blocks costs less.
NARROW = 12


def near_hashes(hashes: DataFrame, most: int = 4, bits: int = 64, code: str = "ahash") -> DataFrame:
    """(h1, h2, distance) of distinct hashes that differ in at most `most` bits, each also with itself.

    Cut into most + 1 bands, two such hashes agree in one band at least, so an equi-join by band loses none. Narrow bands hold
    too many pairs: then all pairs are compared, by blocks in matrices, and none but the near ones becomes a row.
    """
    width = -(-bits // (most + 1))
    own = hashes.select(F.col(code).alias("h")).where("h is not null").distinct()
    if width < NARROW:
        return _near_by_blocks(own, most)
    cut = lambda k: F.shiftrightunsigned("h", k * width).bitwiseAND(F.lit((1 << min(width, bits - k * width)) - 1).cast("bigint"))
    b = own.select("h", F.posexplode(F.array(*(cut(k) for k in range(most + 1)))).alias("band", "v"))
    x, y = b.alias("x"), b.alias("y")
    d = hamming(F.col("x.h"), F.col("y.h"))
    return x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.v") == F.col("y.v")) & (F.col("x.h") <= F.col("y.h"))).where(d <= most).select(F.col("x.h").alias("h1"), F.col("y.h").alias("h2"), d.alias("distance")).distinct()


def _near_by_blocks(own: DataFrame, most: int) -> DataFrame:
    """near_hashes() of distinct hashes: a task meets one pair of blocks at a time, and each pair of hashes is met once."""
    own = written(own, "hashes")
    n = max(1, -(-own.count() // BLOCK))
    kind = own.schema["h"].dataType
    cast = own.select(F.col("h").cast("bigint").alias("h"))
    blocks = cast.groupBy(F.pmod(F.xxhash64("h"), F.lit(n)).cast("int").alias("block")).agg(F.collect_list("h").alias("hs"))
    blocks = written(blocks, "blocks")
    x, y = blocks.toDF("b1", "x"), blocks.toDF("b2", "y")
    # pairs of blocks are dealt out first, as numbers, so many to a task at most
    tasks = max(4 * own.sparkSession.sparkContext.defaultParallelism, n * (n + 1) // 2 // PAIRS)
    pairs = blocks.select(F.col("block").alias("b1"), F.explode(F.sequence(F.col("block"), F.lit(n - 1))).alias("b2")).repartition(tasks, "b1", "b2")
    pairs = pairs.join(x, "b1").join(y, "b2").select("b1", "b2", "x", "y")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                a, b = (batch.column(k).slice(r, 1).flatten().to_numpy() for k in (2, 3))
                same = batch.column(0)[r].as_py() == batch.column(1)[r].as_py()
                for k in range(0, len(a), AT_ONCE):
                    few = a[k : k + AT_ONCE]
                    d = np.bitwise_count(few[:, None].view(np.uint64) ^ b.view(np.uint64))
                    at, to = np.nonzero(d <= most)
                    d, at = d[at, to], few[at]
                    to = b[to]
                    once = at <= to if same else np.ones(len(at), dtype=bool)
                    if once.any():
                        h1, h2 = np.minimum(at, to)[once], np.maximum(at, to)[once]
                        yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(d[once].astype(np.int32))], names=["h1", "h2", "distance"])

    found = pairs.mapInArrow(over, "h1 bigint, h2 bigint, distance int")
    return found.select(F.col("h1").cast(kind).alias("h1"), F.col("h2").cast(kind).alias("h2"), "distance")


def near_images(images: DataFrame, most: int = 4, bits: int = 64, key: str = "case_id", code: str = "ahash") -> DataFrame:
    """(a, b, distance): images of different splits whose hashes differ in at most `most` bits."""
    own = images.select(F.col(code).alias("h"), F.col(key).alias("id"), "split")
    pairs = near_hashes(images, most, bits, code)
    x, y = own.select(F.col("h").alias("h1"), F.col("id").alias("x"), F.col("split").alias("sx")), own.select(F.col("h").alias("h2"), F.col("id").alias("y"), F.col("split").alias("sy"))
    return pairs.join(x, "h1").join(y, "h2").where("sx != sy").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance").distinct()


def balanced_sample(df: DataFrame, group: str, key: str) -> DataFrame:
    """As many rows of each group as the smallest has, by the order of the MD5 of their key."""
    n = df.groupBy(group).agg(F.count("*").alias("n")).agg(F.min("n").alias("least"))
    r = df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.md5(F.col(key).cast("string")), key)))
    return r.crossJoin(F.broadcast(n)).where(F.col("_r") <= F.col("least")).drop("_r", "least")


def interleaved(df: DataFrame, order: str, every: int = 3) -> DataFrame:
    """df with holdout: every `every`-th row in order."""
    from quillon.plans.prefix import numbered

    n = numbered(df, order, name="_n")
    return n.withColumn("holdout", F.pmod(F.col("_n") - 1, F.lit(every)) == every - 1).drop("_n")


def average_hash_bits(small: Column) -> Column:
    """64 block means -> the hash as a signed 64-bit integer: a bit for each mean above the median, the first one highest."""
    s = F.array_sort(small)
    median = (s[31] + s[32]) / 2.0
    return F.aggregate(small, F.lit(0).cast("bigint"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.when(x > median, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))))
