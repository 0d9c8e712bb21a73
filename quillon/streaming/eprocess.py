"""The sequential test on a stream: state by trial, one bet per patient cluster."""

from __future__ import annotations

from collections.abc import Iterator
from math import log
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "trial string, n bigint, log_wealth double, max_log_wealth double, accepted_at bigint, refused bigint, closed boolean"
STATE = "log_wealth double, max_log_wealth double, sum_x double, sum_x2 double, n bigint, accepted_at bigint, refused bigint, closed boolean"
#: Keyed state needs a store that reads one key at a time.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Trial(StatefulProcessor):
    """One trial: its wealth is a value, its clusters are a map, read and written by the clusters of a micro-batch alone."""

    def __init__(self, margin: float, alpha: float, idle: int | None) -> None:
        self.margin, self.alpha, self.idle = margin, alpha, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.test = handle.getValueState("test", STATE)
        self.seen = handle.getMapState("seen", "pid string", "place bigint")

    def _row(self, key: tuple[Any, ...], state: tuple) -> pd.DataFrame:
        wealth, top, _, _, n, at, refused, closed = state
        return pd.DataFrame({"trial": [key[0]], "n": [n], "log_wealth": [wealth], "max_log_wealth": [top], "accepted_at": pd.array([at], dtype="Int64"), "refused": [refused], "closed": [closed]})

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        clusters: dict[str, list[float]] = {}  # first place, sum and number of differences
        for part in rows:
            part = part[(part["y"] == 1) & part["pid"].notna()]
            for pid, seq, d in zip(part["pid"], part["seq"], part["cand"] - part["champ"], strict=True):
                held = clusters.setdefault(pid, [seq, 0.0, 0])
                held[0], held[1], held[2] = min(held[0], seq), held[1] + d, held[2] + 1
        wealth, top, sx, sx2, n, at, refused, closed = self.test.get() or (0.0, 0.0, self.margin, self.margin**2 + 0.25, 0, None, 0, False)
        lam = min(max(sx / sx2, 0.0), 0.5 / (1 - self.margin))
        for pid, (_, total, count) in sorted(clusters.items(), key=lambda c: (c[1][0], c[0])):
            if closed or self.seen.containsKey((pid,)):
                refused += 1
                continue
            x = total / count + self.margin
            wealth += log(1 + lam * x)
            top, n, sx, sx2 = max(top, wealth), n + 1, sx + x, sx2 + x * x
            if at is None and wealth >= log(1 / self.alpha):
                at = n
            self.seen.updateValue((pid,), (n,))
        state = (wealth, top, sx, sx2, n, at, refused, closed)
        self.test.update(state)
        if self.idle is not None and not closed:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield self._row(key, state)

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        state = (*self.test.get()[:-1], True)
        self.test.update(state)
        self.seen.clear()
        yield self._row(key, state)

    def close(self) -> None:
        pass


def test_stream(outcomes: DataFrame, margin: float = 0.02, alpha: float = 0.05, idle: int | None = None) -> DataFrame:
    """outcomes (trial, seq, pid, y, cand, champ) as a stream -> the state of each trial after each micro-batch.

    The outcomes of a micro-batch form one batch of the test: its bet is set by earlier batches, its clusters come in order
    of their first seq. A cluster seen before is refused and counted, since a stream cannot raise for one row; rows
    without a pid don't count. With idle, a trial without outcomes for so many milliseconds closes: its clusters are forgotten, its
    result stays, and what comes later is refused. The session needs the settings STORE.
    """
    name = next(iter(STORE))
    if "RocksDB" not in outcomes.sparkSession.conf.get(name, ""):
        raise ValueError(f"keyed state needs {name} = {STORE[name]}")
    return outcomes.groupBy("trial").transformWithStateInPandas(Trial(margin, alpha, idle), OUT, "Update", "None" if idle is None else "ProcessingTime")


def first_outcomes(outcomes: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """One outcome per cluster and watermark span, silently: for feeds that repeat themselves."""
    return outcomes.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(["trial", "pid"])


def windowed_costs(events: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Costs per lane and window of event time; rows later than the watermark are dropped."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return e.groupBy(F.window(ts, width), "lane").agg(F.count("*").alias("n"), F.sum("usd").alias("usd"))


def ingest(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what has arrived to a table of files, once each, then stop."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
