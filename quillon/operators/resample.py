"""Clustered resampling of patients: the metric of each resample is weighted, cases are never copied.

Resampling with replacement gives each of many patients a count that is nearly Poisson with mean 1. Here the count
is a hash of patient and iteration, so any task can tell it without a table of weights, and any engine can repeat it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.plans.written import written

#: Modulus of the hash, and the factors that set iterations apart.
PRIME, FIRST, SECOND = (1 << 31) - 1, 48271, 69621
#: A hash below the k-th of these and not below the one before gives the weight k.
CUTS = [int(PRIME * exp(-1) * sum(1 / factorial(j) for j in range(k + 1))) for k in range(12)]
#: Cases of a segment that one task looks into, parts that an arm is cut into at once, and cells (cases x iterations) that a task holds at a time.
RANGE_ROWS, CUTS_OF_ARM, CELLS = 20_000, 64, 1 << 21
#: Tasks that add up the sums of many.
FAN = 32
#: Patients whose counts and weights are multiplied at once.
PATIENTS = 4096


def patient_code(pid: Column) -> Column:
    """28 bits of a patient, by MD5."""
    return F.conv(F.substring(F.md5(pid.cast("string")), 1, 7), 16, 10).cast("bigint")


def weight_matrix(code: np.ndarray, its: np.ndarray) -> np.ndarray:
    """The same weights for patients x iterations."""
    code = code.astype(np.uint64)[:, None]
    p, it = np.uint64(PRIME), its.astype(np.uint64)[None, :] + np.uint64(1)
    a, b = it * np.uint64(FIRST) % p, it * np.uint64(SECOND) % p
    v = (code * a + b) % p
    for more in (a, b, code):
        v = (v * v + more) % p
    return np.searchsorted(np.array(CUTS, dtype=np.uint64), v.ravel(), side="right").reshape(v.shape).astype(np.int64)


def hashed_weights(patients: DataFrame, iterations: int, pid: str = "pid") -> DataFrame:
    """(it, pid, w): the weight of each patient in each iteration."""
    out = patients.select(pid, patient_code(F.col(pid)).alias("_code")).distinct().withColumn("it", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(iterations - 1).cast("bigint"))))
    out = out.select("it", pid, "_code", *(((F.col("it") + 1) * k % PRIME).alias(name) for name, k in (("_a", FIRST), ("_b", SECOND))))
    # a column for each step, so that none is computed twice
    out = out.withColumn("_v", (F.col("_code") * F.col("_a") + F.col("_b")) % PRIME)
    for more in ("_a", "_b", "_code"):
        out = out.withColumn("_v", (F.col("_v") * F.col("_v") + F.col(more)) % PRIME)
    return out.select("it", pid, reduce(lambda a, b: a + b, ((F.col("_v") >= cut).cast("bigint") for cut in CUTS)).alias("w"))


def _blocks(n: int, rows: int) -> list[np.ndarray]:
    """Iterations 0 to n - 1 in blocks that fit beside so many rows."""
    size = max(1, CELLS // max(rows, 1))
    return [np.arange(k, min(k + size, n)) for k in range(0, n, size)]


@dataclass
class Segment:
    """Scores above low and up to high of one arm: cases, least and largest score, weighted negatives and positives of each iteration."""

    low: float
    high: float
    cases: int
    least: float
    largest: float
    negatives: np.ndarray
    positives: np.ndarray

    def single(self) -> bool:
        return self.least == self.largest


@dataclass
class Draws:
    """True draws with replacement of n patients, who are numbered in their order; chunk iterations are held at a time."""

    n: int
    seed: int
    chunk: int

    def multiplicities(self, who: np.ndarray, last: int) -> Iterator[tuple[int, np.ndarray]]:
        """(iteration, how often each of who is drawn) up to last. Every task draws again from the seed."""
        rng = np.random.default_rng(self.seed)
        for it in range(last + 1):
            yield it, np.bincount(rng.choice(self.n, size=self.n, replace=True), minlength=self.n)[who]

    def matrix(self, who: np.ndarray, its: np.ndarray) -> np.ndarray:
        """Patients x iterations, its ascending; no patient is drawn 65,536 times."""
        out, place = np.zeros((len(who), len(its)), np.uint16), {int(it): k for k, it in enumerate(its)}
        for it, drawn in self.multiplicities(who, int(its[-1]) if len(its) else -1):
            if it in place:
                out[:, place[it]] = drawn
        return out

    def add(self, sums: list[np.ndarray], code: np.ndarray, keys: list[np.ndarray], iterations: int) -> None:
        """Add the weights of rows to the sums (keys x iterations) of each arm: counts of keys and patients times patients and iterations."""
        who, at = np.unique(code, return_inverse=True)
        order = np.argsort(at, kind="stable")
        at, keys = at[order], [k[order] for k in keys]
        held, first = np.zeros((len(who), self.chunk), np.uint16), 0
        for it, drawn in self.multiplicities(who, iterations - 1):
            held[:, it - first] = drawn
            if it + 1 - first < self.chunk and it + 1 < iterations:
                continue
            for a in range(0, len(who), PATIENTS):
                weight = held[a : a + PATIENTS, : it + 1 - first].astype(np.float64)
                begin, end = np.searchsorted(at, (a, a + PATIENTS))
                for total, key in zip(sums, keys, strict=True):
                    mine = key[begin:end]
                    place, mine = at[begin:end][mine >= 0] - a, mine[mine >= 0]
                    count = np.bincount(mine * len(weight) + place, minlength=len(total) * len(weight)).reshape(len(total), len(weight))
                    some = np.flatnonzero(count.any(axis=1))
                    # whole numbers far below 2^53, so doubles add them up exactly
                    total[some, first : it + 1] += (count[some].astype(np.float64) @ weight).astype(np.int64)
            first = it + 1


def _sums(rows: DataFrame, edges: list[np.ndarray], wanted: list[np.ndarray], iterations: int, draws: Draws | None = None) -> list[list[Segment | None]]:
    """For each arm the segments between its edges, those that wanted marks, over all rows (code, y, s0, s1, ...).

    No row is moved: every task adds up its own, a few tasks add up theirs, one those. The driver gets one state an arm.
    """
    sizes = [len(e) + 1 for e in edges]
    schema = "arm int, cases binary, least binary, largest binary, sums binary"

    def empty(n: int) -> list[np.ndarray]:
        return [np.zeros(n, np.int64), np.full(n, np.inf), np.full(n, -np.inf), np.zeros((2 * n, iterations), np.int64)]

    def batches_of(states: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for arm, state in enumerate(states):
            if state[0].any():
                yield pa.RecordBatch.from_arrays([pa.array([arm], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in state)], names=["arm", "cases", "least", "largest", "sums"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = [empty(n) for n in sizes]
        codes: list[np.ndarray] = []
        found: list[list[np.ndarray]] = [[] for _ in sizes]
        for batch in batches:
            code, y, *scores = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns))
            for (cases, least, largest, sums), s, edge, some, kept in zip(states, scores, edges, wanted, found, strict=True):
                part = np.searchsorted(edge, s)
                mine = np.flatnonzero(~np.isnan(s) & some[part])
                key = 2 * part[mine] + y[mine]
                if draws:
                    kept.append(np.full(len(s), -1, np.int32))
                    kept[-1][mine] = key
                if not len(mine):
                    continue
                order = np.argsort(key, kind="stable")
                mine, key = mine[order], key[order]
                np.add.at(cases, part[mine], 1)
                np.minimum.at(least, part[mine], s[mine])
                np.maximum.at(largest, part[mine], s[mine])
                if draws:
                    continue
                starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                who, at = np.unique(code[mine], return_inverse=True)
                for its in _blocks(iterations, len(mine)):
                    sums[key[starts][:, None], its] += np.add.reduceat(weight_matrix(who, its)[at], starts, axis=0)
            if draws:
                codes.append(code)
        if codes:
            draws.add([state[3] for state in states], np.concatenate(codes), [np.concatenate(k) for k in found], iterations)
        yield from batches_of(states)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = [empty(n) for n in sizes]
        for batch in batches:
            for row in batch.to_pylist():
                cases, least, largest, sums = states[row["arm"]]
                cases += np.frombuffer(row["cases"], np.int64)
                np.minimum(least, np.frombuffer(row["least"]), out=least)
                np.maximum(largest, np.frombuffer(row["largest"]), out=largest)
                sums += np.frombuffer(row["sums"], np.int64).reshape(sums.shape)
        yield from batches_of(states)

    states = rows.mapInArrow(count, schema).withColumn("_to", F.spark_partition_id()).repartition(FAN, "_to").drop("_to").mapInArrow(add, schema)
    out: list[list[Segment | None]] = [[None] * n for n in sizes]
    for row in states.repartition(1).mapInArrow(add, schema).collect():
        cases, least, largest = np.frombuffer(row.cases, np.int64), np.frombuffer(row.least), np.frombuffer(row.largest)
        sums = np.frombuffer(row.sums, np.int64).reshape(-1, 2, iterations)
        bounds = [-np.inf, *edges[row.arm], np.inf]
        out[row.arm] = [Segment(bounds[k], bounds[k + 1], int(cases[k]), least[k], largest[k], sums[k, 0], sums[k, 1]) if cases[k] else None for k in range(len(cases))]
    return out


def _cuts(rows: DataFrame, segments: list[list[Segment]], parts: int) -> list[np.ndarray]:
    """Edges that part each arm's segments: approximate quantiles, and what sets the least and the largest score of a segment apart."""
    fractions = [k / parts for k in range(1, parts)]
    asks = [F.percentile_approx(F.when(_between(F.col(f"s{arm}"), g.low, g.high), F.col(f"s{arm}")), fractions, 1000).alias(f"c{arm}_{k}") for arm, found in enumerate(segments) for k, g in enumerate(found)]
    seen = rows.agg(*asks).first() if asks else {}
    out = []
    for arm, found in enumerate(segments):
        edges = {x for k, g in enumerate(found) for x in (g.low, g.high, g.least, np.nextafter(g.largest, -np.inf), *(seen[f"c{arm}_{k}"] or []))}
        out.append(np.array(sorted(x for x in edges if np.isfinite(x)), dtype=np.float64))
    return out


def resampled_sensitivity(cases: DataFrame, scores: list[str], iterations: int = 2000, specificity: float = 0.96, y: str = "y", pid: str = "pid") -> DataFrame:
    """(it, arm, sensitivity) of each resample: the k-th negative is the first score whose running weight reaches k.

    Scores are cut into segments whose weights are summed for all resamples at once. Those that hold a resample's threshold are
    cut again until none has more than RANGE_ROWS cases or more than one score; a last pass looks inside them. The driver
    holds a few hundred segments of an arm, two numbers an iteration each, however many cases there are. A resample
    without positives or negatives has null; cases without a label, a patient or a score are left out (of that arm).
    """
    rows = cases.select(patient_code(F.col(pid)).alias("code"), F.col(y).cast("int").alias("y"), *(F.col(s).cast("double").alias(f"s{k}") for k, s in enumerate(scores))).where("code is not null and y in (0, 1)")
    return _sensitivity(rows, scores, iterations, specificity)


def _sensitivity(rows: DataFrame, scores: list[str], iterations: int, specificity: float, draws: Draws | None = None) -> DataFrame:
    """resampled_sensitivity() of rows (code, y, s0, s1, ...); with draws, code is the patient's number and its weights are drawn."""
    spark = rows.sparkSession
    whole = [Segment(-np.inf, np.inf, 0, np.inf, np.inf, np.zeros(iterations, np.int64), np.zeros(iterations, np.int64)) for _ in scores]
    held: list[list[Segment]] = [[g] for g in whole]
    needed: list[list[Segment]] = held
    total, where = np.zeros((len(scores), iterations), np.int64), np.zeros((len(scores), iterations), np.int64)
    while any(needed) and iterations:
        edges = _cuts(rows, needed, max(4, CUTS_OF_ARM // max(1, *map(len, needed))))
        lows = [{g.low: g for g in found} for found in needed]
        parts = [np.concatenate([[-np.inf], e]) for e in edges]
        inside = [np.array([any(g.low <= a < g.high for g in found) for a in at], dtype=bool) for at, found in zip(parts, needed, strict=True)]
        new = _sums(rows, edges, inside, iterations, draws)
        for arm, found in enumerate(new):
            kept = [g for g in held[arm] if g.low not in lows[arm]]
            held[arm] = sorted([*kept, *(g for g in found if g is not None)], key=lambda g: g.low)
            if held[arm]:
                upto = np.stack([g.negatives for g in held[arm]]).cumsum(axis=0)
                total[arm] = upto[-1]
                where[arm] = (upto >= _rank(specificity, upto[-1])[None]).argmax(axis=0)
        # cut again what holds a threshold and is large
        needed = [[g for k in np.unique(where[arm][total[arm] > 0]) if (g := held[arm][k]).cases > RANGE_ROWS and not g.single()] for arm in range(len(scores))]

    if not any(held[arm] and held[arm][0].cases for arm in range(len(scores))):
        return spark.createDataFrame([], "it bigint, arm string, sensitivity double")
    values = np.full((len(scores), iterations), np.nan)
    above, rest, groups = np.zeros_like(total), np.zeros_like(total), []
    for arm, found in enumerate(held):
        if not found or not iterations:
            continue
        negatives, positives = np.stack([g.negatives for g in found]), np.stack([g.positives for g in found])
        after = np.arange(len(found))[:, None] > where[arm][None]
        above[arm] = np.where(after, positives, 0).sum(axis=0)
        rest[arm] = _rank(specificity, total[arm]) - np.where(np.arange(len(found))[:, None] < where[arm][None], negatives, 0).sum(axis=0)
        values[arm] = positives.sum(axis=0)
        groups += [(arm, k, found[k].low, found[k].high) for k in np.unique(where[arm][total[arm] > 0]) if not found[k].single()]

    def look(key: tuple, t: pa.Table) -> pa.Table:
        arm, k = (x.as_py() for x in key)
        its = np.flatnonzero((where[arm] == k) & (total[arm] > 0))
        t = t.sort_by("s")
        s, code, label = (t[x].to_numpy() for x in ("s", "code", "y"))
        last = np.flatnonzero(np.concatenate([s[1:] != s[:-1], [True]]))
        who, at = np.unique(code, return_inverse=True)
        caught = np.zeros(len(its), np.int64)
        drawn = draws.matrix(who, its) if draws else None
        for block in _blocks(len(its), len(s)):
            w = (weight_matrix(who, its[block]) if drawn is None else drawn[:, block].astype(np.int64))[at]
            stop = (np.cumsum(np.where(label[:, None] == 0, w, 0), axis=0)[last] >= rest[arm, its[block]][None]).argmax(axis=0)
            hits = np.cumsum(np.where(label[:, None] == 1, w, 0), axis=0)[last]
            caught[block] = hits[-1] - hits[stop, np.arange(len(block))]
        return pa.table({"arm": np.full(len(its), arm), "it": its, "caught": caught})

    if groups:
        arms = []
        for arm in range(len(scores)):
            s = F.col(f"s{arm}")
            at = F.coalesce(*(F.when(_between(s, low, high), F.lit(int(k))) for a, k, low, high in groups if a == arm), F.lit(None).cast("int"))
            arms.append(rows.select(F.lit(arm).alias("arm"), at.alias("k"), "code", "y", s.alias("s")).where("k is not null and not isnan(s)"))
        found = reduce(DataFrame.unionByName, arms).groupBy("arm", "k").applyInArrow(look, "arm bigint, it bigint, caught bigint")
        for r in found.collect():
            above[r.arm, r.it] += r.caught
    ok = (total > 0) & (values > 0)
    table = pa.table({
        "it": pa.array(np.tile(np.arange(iterations), len(scores)), pa.int64()), "arm": pa.array(np.repeat(scores, iterations).tolist(), pa.string()),
        "sensitivity": pa.array(np.where(ok, above / np.where(ok, values, 1), 0.0).ravel(), pa.float64(), mask=~ok.ravel()),
    })
    return spark.createDataFrame(table)


def _between(s: Column, low: float, high: float) -> Column:
    return ~F.isnan(s) & (s <= high) & (s > low if low > -np.inf else F.lit(True))


def _rank(specificity: float, negatives: np.ndarray) -> np.ndarray:
    """Which of so many negatives has the threshold, counted from 1."""
    return np.minimum(np.maximum(np.ceil(specificity * negatives).astype(np.int64), 1), negatives)


def paired_delta(cases: DataFrame, iterations: int = 2000, cand: str = "cand", champ: str = "champ", alpha: float = 0.05, specificity: float = 0.96, y: str = "y", pid: str = "pid") -> DataFrame:
    """(point, lo, hi, n): the paired difference of sensitivities, and its interpolated quantiles over shared resamples.

    Resamples without a value don't count; without any, lo and hi are null. The point is the difference on the cases as they are.
    """
    from quillon.operators.metrics import sensitivity_at_specificity

    s = resampled_sensitivity(cases, [cand, champ], iterations, specificity, y, pid)
    d = s.groupBy("it").agg((F.max(F.when(F.col("arm") == cand, F.col("sensitivity"))) - F.max(F.when(F.col("arm") == champ, F.col("sensitivity")))).alias("d")).where("d is not null")
    ends = d.agg(F.percentile("d", F.lit(alpha / 2)).alias("lo"), F.percentile("d", F.lit(1 - alpha / 2)).alias("hi"), F.count("*").alias("n"))
    arm = lambda x: sensitivity_at_specificity(cases.select(F.col(y).alias("y"), F.col(x).alias("score")), specificity).select(F.col("sensitivity").alias(f"s_{x}"))
    # one row each
    return ends.crossJoin(F.broadcast(arm(cand))).crossJoin(F.broadcast(arm(champ))).select((F.col(f"s_{cand}") - F.col(f"s_{champ}")).alias("point"), "lo", "hi", "n")


def drawn_weights(patients: list[str], iterations: int, seed: int = 0) -> np.ndarray:
    """Multiplicities (iterations x patients) of true draws with replacement, patients in lexicographic order."""
    rng, n = np.random.default_rng(seed), len(patients)
    return np.stack([np.bincount(rng.choice(n, size=n, replace=True), minlength=n) for _ in range(iterations)]) if iterations else np.zeros((0, n), int)


def _numbered(patients: DataFrame) -> DataFrame:
    """(pid, code) of distinct patients: their places in lexicographic order, from 0."""
    ranged = patients.repartitionByRange("pid").sortWithinPartitions("pid").select("pid", F.monotonically_increasing_id().alias("_at"))
    ranged = written(ranged.select("pid", F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "patients")
    # a row for each of the partitions
    before = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return ranged.join(F.broadcast(before), "_part").select("pid", (F.col("_before") + F.col("_at")).alias("code"))


def bootstrap(cases: DataFrame, scores: list[str], iterations: int = 2000, seed: int = 0, specificity: float = 0.96, y: str = "y", pid: str = "pid", chunk: int = 250) -> DataFrame:
    """(it, arm, sensitivity) with drawn multiplicities, patients in lexicographic order.

    Rows are dealt to tasks by ranges of patients once, for all arms; a task draws every iteration again from the seed and keeps what falls
    to its own patients, chunk iterations at a time. Thresholds are found as in resampled_sensitivity, so no task holds an
    arm; the numbers of one draw, 8 bytes a patient, must fit in a task. Cases without a label or a score are left out (of that arm); their
    patients are drawn all the same.
    """
    rows = cases.select(F.col(pid).cast("string").alias("pid"), F.col(y).cast("int").alias("y"), *(F.col(s).cast("double").alias(f"s{k}") for k, s in enumerate(scores))).where("pid is not null")
    patients = _numbered(rows.select("pid").distinct())
    n = patients.count()
    coded = rows.where("y in (0, 1)").join(patients, "pid").select("code", "y", *rows.columns[2:])
    coded = written(coded.repartitionByRange("code"), "drawn")
    return _sensitivity(coded, scores, iterations, specificity, Draws(n, seed, chunk))
