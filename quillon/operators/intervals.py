"""Confidence intervals of any metric over patients drawn again: one pass carries the states of all resamples.

A metric is a start, an add, a merge and a finish over arrays with a place for each resample. Tasks add up rows as they
stream by, their states are merged in the order of the tasks, and the last task finishes them. Place 0 has every weight 1,
so the metric's own value comes out of the same pass.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.resample import CELLS, patient_code, resampled_sensitivity, weight_matrix

#: States that are merged in one task before the last one merges what is left, one by one.
FAN = 32


@dataclass
class State:
    """sums has a row for each figure and a column for each resample; marks are numbers that all resamples share."""

    sums: np.ndarray
    marks: list[float] = field(default_factory=list)


class Metric(ABC):
    """A metric of (y, score) rows with weights. ordered: rows come in ascending order of their scores, ties in any."""

    ordered = False
    figures = 0

    def start(self, places: int) -> State:
        return State(np.zeros((self.figures, places)))

    @abstractmethod
    def add(self, y: np.ndarray, s: np.ndarray, w: np.ndarray) -> State:
        """The state of some rows alone; w is rows x resamples."""

    @abstractmethod
    def merge(self, a: State, b: State) -> State:
        """The state of the rows of a and, not before them, those of b."""

    @abstractmethod
    def finish(self, state: State) -> np.ndarray:
        """A value for each resample, nan where there is none."""


class Mean(Metric):
    """The weighted mean of a figure of each row."""

    figures = 2

    def figure(self, y: np.ndarray, s: np.ndarray) -> np.ndarray:
        return s

    def add(self, y: np.ndarray, s: np.ndarray, w: np.ndarray) -> State:
        return State(np.stack([self.figure(y, s) @ w, w.sum(axis=0)]))

    def merge(self, a: State, b: State) -> State:
        return State(a.sums + b.sums)

    def finish(self, state: State) -> np.ndarray:
        total, n = state.sums
        return np.where(n > 0, total / np.where(n > 0, n, 1), np.nan)


class Brier(Mean):
    """The mean squared distance of score and label."""

    def figure(self, y: np.ndarray, s: np.ndarray) -> np.ndarray:
        return (s - y) ** 2


class Accuracy(Mean):
    """The share of rows on the label's side of a threshold, which counts as positive."""

    def __init__(self, threshold: float = 0.5) -> None:
        self.threshold = threshold

    def figure(self, y: np.ndarray, s: np.ndarray) -> np.ndarray:
        return ((s >= self.threshold) == (y == 1)).astype(np.float64)


class Auroc(Metric):
    """The share of pairs of a positive and a negative in the right order, ties counting half.

    sums: right pairs, positives, negatives, then both of the first and both of the last score; marks: those two scores. Rows
    that tie may lie in several states, since a merge counts the pairs of a border's tie as half.
    """

    ordered, figures = True, 7

    def add(self, y: np.ndarray, s: np.ndarray, w: np.ndarray) -> State:
        starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        p, n = (np.add.reduceat(w * (y == k)[:, None], starts, axis=0) for k in (1, 0))
        pairs = (p * (np.cumsum(n, axis=0) - n / 2)).sum(axis=0)
        return State(np.stack([pairs, p.sum(axis=0), n.sum(axis=0), p[0], n[0], p[-1], n[-1]]), [float(s[0]), float(s[-1])])

    def merge(self, a: State, b: State) -> State:
        if not a.marks or not b.marks:
            return b if not a.marks else a
        pairs = a.sums[0] + b.sums[0] + a.sums[2] * b.sums[1]
        first, last = a.sums[3:5], b.sums[5:7]
        if a.marks[1] == b.marks[0]:
            pairs += (a.sums[5] * b.sums[4] - a.sums[6] * b.sums[3]) / 2
            first = first + b.sums[3:5] if a.marks[0] == a.marks[1] else first
            last = last + a.sums[5:7] if b.marks[0] == b.marks[1] else last
        return State(np.concatenate([[pairs, a.sums[1] + b.sums[1], a.sums[2] + b.sums[2]], first, last]), [a.marks[0], b.marks[1]])

    def finish(self, state: State) -> np.ndarray:
        both = state.sums[1] * state.sums[2]
        return np.where(both > 0, state.sums[0] / np.where(both > 0, both, 1), np.nan)


def resampled(cases: DataFrame, metric: Metric, iterations: int = 2000, score: str = "score", y: str = "y", pid: str = "pid") -> DataFrame:
    """(it, value): the metric of each resample, and of the cases as they are at it = -1; null where there is none.

    Cases without a patient, a label or a score are left out. Ordered metrics get ranges of the scores; a score that very many
    cases share is parted by patients. No task holds more than one batch of rows and a few states.
    """
    rows = cases.select(F.col(score).cast("double").alias("s"), patient_code(F.col(pid)).alias("code"), F.col(y).cast("double").alias("y")).where("s is not null and not isnan(s) and code is not null and y in (0, 1)")
    if metric.ordered:
        rows = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "s", "code").sortWithinPartitions("s", "code")
    places, schema = iterations + 1, "task int, sums binary, marks array<double>"

    def weighted(code: np.ndarray, its: np.ndarray) -> np.ndarray:
        who, at = np.unique(code, return_inverse=True)
        w = np.ones((len(who), len(its)))
        w[:, its >= 0] = weight_matrix(who, its[its >= 0])
        return w[at]

    def batch_of(task: int, state: State) -> pa.RecordBatch:
        marks = pa.array([state.marks], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([state.sums.tobytes()], pa.binary()), marks], names=["task", "sums", "marks"])

    def states(columns: list) -> Iterator[tuple[int, State]]:
        for task, sums, marks in zip(*columns, strict=True):
            yield task, State(np.frombuffer(sums).reshape(-1, places), marks)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = None
        for batch in batches:
            s, code, y_ = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if not len(s):
                continue
            size = max(1, CELLS // len(s))
            parts = [metric.add(y_, s, weighted(code, np.arange(k, min(k + size, iterations)))) for k in range(-1, iterations, size)]
            own = State(np.concatenate([x.sums for x in parts], axis=1), parts[0].marks)
            held = own if held is None else metric.merge(held, own)
        if held is not None:
            yield batch_of(TaskContext.get().partitionId(), held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held = None, None
        for batch in batches:
            for task, state in states([batch.column(k).to_pylist() for k in range(3)]):
                if task // FAN != of:
                    if held is not None:
                        yield batch_of(of, held)
                    of, held = task // FAN, state
                else:
                    held = metric.merge(held, state)
        if held is not None:
            yield batch_of(of, held)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for _, state in states([batch.column(k).to_pylist() for k in range(3)]):
                held = state if held is None else metric.merge(held, state)
        if held is not None:
            value = metric.finish(held)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, iterations)), pa.array(value, from_pandas=True)], names=["it", "value"])

    first = rows.mapInArrow(add, schema)
    some = first.withColumn("_to", F.floor(F.col("task") / FAN)).repartition("_to").sortWithinPartitions("task").drop("_to").mapInArrow(merge, schema)
    return some.repartition(1).sortWithinPartitions("task").mapInArrow(last, "it bigint, value double")


def interval(cases: DataFrame, metric: Metric | str, iterations: int = 2000, alpha: float = 0.05, score: str = "score", y: str = "y", pid: str = "pid", specificity: float = 0.96) -> DataFrame:
    """(point, lo, hi, n): the metric of the cases, interpolated quantiles of its resamples, and how many of these have a value.

    metric is a Metric, or "sensitivity" for the one at a specificity, whose threshold depends on all cases of a resample
    and takes a pass more. Without a value point, without resamples lo and hi are null.
    """
    if metric == "sensitivity":
        from quillon.operators.metrics import sensitivity_at_specificity

        own = cases.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(y).isin(0, 1) & F.col(pid).isNotNull())
        point = sensitivity_at_specificity(own, specificity, y, score).select(F.lit(-1).cast("bigint").alias("it"), F.col("sensitivity").alias("value"))
        values = resampled_sensitivity(cases, [score], iterations, specificity, y, pid).select("it", F.col("sensitivity").alias("value")).unionByName(point)
    else:
        values = resampled(cases, metric, iterations, score, y, pid)
    drawn = F.when(F.col("it") >= 0, F.col("value"))
    # one row for each iteration
    return values.agg(F.max(F.when(F.col("it") < 0, F.col("value"))).alias("point"), F.percentile(drawn, F.lit(alpha / 2)).alias("lo"), F.percentile(drawn, F.lit(1 - alpha / 2)).alias("hi"), F.count(drawn).alias("n"))
