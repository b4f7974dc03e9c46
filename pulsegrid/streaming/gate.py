"""The anomaly gate: rolling median, M-of-N persistence, refractory period and re-arming.

A score is smoothed over the last ones and is abnormal at or above the threshold. A step is high with m
abnormal marks among the last n, else low. The gate is ready as long as it has not woken, and again once some low
step lies `refractory` or more after the last wake. It wakes at a high step if it is ready before that step.

So all that decides are three numbers: the last wake, the last low step, and the present one. Wakes are at
first steps of runs of high ones, which is what the batch plan walks; the rest are windows. A stream
keeps those numbers and the tails of the scores and marks for each device.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .state import remembered


@dataclass(frozen=True)
class Gate:
    threshold: float
    smooth: int = 1
    m: int = 3
    n: int = 5
    refractory: float = 30.0

    def __post_init__(self):
        if not 1 <= self.m <= self.n:
            raise ValueError("1 <= m <= n is needed")

    @classmethod
    def debounced(cls, threshold: float, debounce: int, **how) -> Gate:
        """The older setting: so many abnormal marks in a row."""
        return cls(threshold, m=debounce, n=debounce, **how)

    def ready(self, last_wake, last_low):
        """Whether a gate that woke and was low at those times (None or null: never) may wake again."""
        if isinstance(last_wake, Column):
            return last_wake.isNull() | F.coalesce(last_low >= last_wake + self.refractory, F.lit(False))
        return last_wake is None or last_low is not None and last_low >= last_wake + self.refractory


class Memory(NamedTuple):
    """What a device's gate must know of earlier steps."""

    scores: tuple[float, ...] = ()
    marks: tuple[int, ...] = ()
    last_wake: float | None = None
    last_low: float | None = None


OUT = "device_id string, t double, score double, smoothed double, abnormal boolean, count int, state string, wake boolean"


def steps(gate: Gate, memory: Memory, t: np.ndarray, score: np.ndarray) -> tuple[Memory, pd.DataFrame]:
    """Decisions for a device's next scores, in order, and the memory after them."""
    smooth = max(1, gate.smooth)
    known = np.concatenate([memory.scores, score])
    behind = np.concatenate([np.full(smooth - 1 - len(memory.scores), np.nan), known])
    smoothed = np.nanmedian(np.lib.stride_tricks.sliding_window_view(behind, smooth), axis=1)
    abnormal = (smoothed >= gate.threshold).astype(np.int64)
    marks = np.concatenate([memory.marks, abnormal]).astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(marks)])
    ends = np.arange(len(memory.marks) + 1, len(marks) + 1)
    count = sums[ends] - sums[np.maximum(ends - gate.n, 0)]
    wake, ready = np.zeros(len(t), dtype=bool), np.zeros(len(t), dtype=bool)
    woke, low = memory.last_wake, memory.last_low
    for i, (now, high) in enumerate(zip(t.tolist(), (count >= gate.m).tolist(), strict=True)):
        if high:
            wake[i] = gate.ready(woke, low)
            woke = now if wake[i] else woke
        else:
            low = now
        ready[i] = gate.ready(woke, low)
    out = pd.DataFrame({"t": t, "score": score, "smoothed": smoothed, "abnormal": abnormal.astype(bool), "count": count, "state": np.where(ready, "armed", "refractory"), "wake": wake})
    last = lambda x, k: tuple(x[max(0, len(x) - k) :].tolist())
    return Memory(last(known, smooth - 1), last(marks, gate.n - 1), woke, low), out


def marked(scores: DataFrame, gate: Gate) -> DataFrame:
    """smoothed, abnormal and count of scores (device_id, t, score), by windows only."""
    order = Window.partitionBy("device_id").orderBy("t")
    smoothed = F.percentile("score", F.lit(0.5)).over(order.rowsBetween(1 - max(1, gate.smooth), 0))
    rows = scores.withColumn("smoothed", smoothed)
    rows = rows.withColumn("abnormal", (F.col("smoothed") >= gate.threshold).cast("int"))
    return rows.withColumn("count", F.sum("abnormal").over(order.rowsBetween(1 - gate.n, 0)))


def wakes(scores: DataFrame, gate: Gate) -> DataFrame:
    """device_id, t of the wakes, in one batch.

    Only the first step of a run of high ones can wake, and of what lies before it only the last low step's time
    counts: those pairs are what is walked for a device, once and in order.
    """
    order = Window.partitionBy("device_id").orderBy("t")
    high = F.col("count") >= gate.m
    turns = marked(scores, gate).withColumns({"low": F.lag("t").over(order), "_was": F.coalesce(F.lag(high).over(order), F.lit(False))}).where(high & ~F.col("_was")).select("device_id", F.col("t").cast("double").alias("t"), F.col("low").cast("double").alias("low"))

    def walk(device: pa.Table) -> pa.Table:
        device = device.sort_by("t")
        last, kept = None, []
        for t, low in zip(device.column("t").to_pylist(), device.column("low").to_pylist(), strict=True):
            kept.append(gate.ready(last, low))
            last = t if kept[-1] else last
        return device.select(["device_id", "t"]).filter(pa.array(kept, pa.bool_()))

    return turns.groupBy("device_id").applyInArrow(walk, "device_id string, t double")


def decided(scores: DataFrame, gate: Gate) -> DataFrame:
    """All decisions of a batch, by windows over the marks and the wakes."""
    order = Window.partitionBy("device_id").orderBy("t")
    woke = wakes(scores, gate).withColumn("wake", F.lit(True))
    rows = marked(scores, gate).join(woke, ["device_id", "t"], "left").withColumn("wake", F.coalesce("wake", F.lit(False)))
    last_wake = F.max(F.when(F.col("wake"), F.col("t"))).over(order)
    last_low = F.max(F.when(F.col("count") < gate.m, F.col("t"))).over(order)
    state = F.when(gate.ready(last_wake, last_low), "armed").otherwise("refractory")
    return rows.select("device_id", "t", "score", "smoothed", F.col("abnormal").cast("boolean").alias("abnormal"), F.col("count").cast("int").alias("count"), state.alias("state"), "wake")


def gated(scores: DataFrame, gate: Gate, watermark: str | None = None, idle: float = 3600.0, ttl: float | None = None) -> DataFrame:
    """Decisions for a stream of scores (device_id, t, score), a device at a time, with state; of a batch, by decided().

    Rows of a device within a micro-batch are taken in the order of t; a row not later than one that was decided
    before is dropped. With `watermark` the rows also have the event time `ts`, rows later than that are
    dropped, and a device's state goes `idle` seconds after its latest event; with `ttl`, so many seconds of the clock after its
    last rows. It then starts anew. Without, state stays.
    """
    if not scores.isStreaming:
        return decided(scores, gate)

    def step(key: tuple, before: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        memory = Memory(tuple(before[0]), tuple(before[1]), before[2], before[3]) if before else Memory()
        latest = before[4] if before else -np.inf
        rows = rows[rows["t"] > latest].sort_values("t")
        memory, out = steps(gate, memory, rows["t"].to_numpy(dtype=float), rows["score"].to_numpy(dtype=float)) if len(rows) else (memory, pd.DataFrame())
        latest = float(rows["t"].iloc[-1]) if len(rows) else latest
        out = out.assign(device_id=key[0])[[c.split()[0] for c in OUT.split(", ")]] if len(rows) else out
        return (list(memory.scores), list(memory.marks), memory.last_wake, memory.last_low, latest), out

    return remembered(scores, "device_id", "scores array<double>, marks array<int>, last_wake double, last_low double, latest double", step, OUT, watermark, idle, ttl)


def start(scores: DataFrame, gate: Gate, on_batch, checkpoint: str, **how):
    """Run the gate on a stream, of a session with the rocksdb() store: on_batch(decisions, batch_id) gets each micro-batch's decisions."""
    return gated(scores, gate, **how).writeStream.outputMode("append").foreachBatch(on_batch).option("checkpointLocation", checkpoint).start()
