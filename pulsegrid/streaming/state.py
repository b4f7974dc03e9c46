"""What a stream keeps for each key: one typed value in the state store, timers of event time or a time to live, and a replay of tables.

State is kept by transformWithState, which needs the RocksDB store: rocksdb() names it for a session.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources import remove, settled, shared_folder

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rocksdb(spark: SparkSession) -> SparkSession:
    """The session, with the state store that streams with state need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


#: A key, its value (None: none yet) and its rows of a micro-batch; the value after them and what is put out.
Step = Callable[[tuple, "tuple | None", pd.DataFrame], "tuple[tuple, pd.DataFrame]"]


class Remembering(StatefulProcessor):
    """Takes a key's rows of a micro-batch at once to `step`, with the key's value; with `idle` (ms) the value goes that long after the latest event time `ts`."""

    def __init__(self, schema: str, step: Step, idle: int | None, ttl: int | None):
        self.schema, self.step, self.idle, self.ttl = schema, step, idle, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # the latest event time stands beside the value
        self.value = handle.getValueState("value", f"{self.schema}, _seen long", self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows))
        before = self.value.get() if self.value.exists() else None
        value, out = self.step(key, before and tuple(before[:-1]), every)
        latest = before[-1] if before else 0
        if self.idle is not None:
            latest = max(latest, int(every["ts"].max().timestamp() * 1000))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(latest + self.idle, timerValues.getCurrentWatermarkInMs() + 1))
        self.value.update((*value, latest))
        if len(out):
            yield out

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.value.clear()
        return iter(())

    def close(self) -> None:
        pass


def remembered(rows: DataFrame, key: str, schema: str, step: Step, out: str, watermark: str | None = None, idle: float = 3600.0, ttl: float | None = None) -> DataFrame:
    """What `step` puts out of a stream, a key at a time, with a value of `schema` as its state.

    With `watermark` rows later than that are dropped, and a value goes `idle` seconds after its key's latest event time `ts`. With `ttl`
    it goes so many seconds of the clock after it was last written. With neither it stays.
    """
    if watermark and ttl:
        raise ValueError("state goes by event time or by the clock, not by both")
    held = rows.withWatermark("ts", watermark) if watermark else rows
    mode = "EventTime" if watermark else "ProcessingTime" if ttl else "None"
    return held.groupBy(key).transformWithStateInPandas(Remembering(schema, step, int(idle * 1000) if watermark else None, int(ttl * 1000) if ttl else None), out, "Append", mode)


def replayed(rows: DataFrame, order: str, parts: int, build: Callable[[DataFrame], DataFrame], folder: str | None = None) -> DataFrame:
    """What a stream that `build` makes puts out for a table that comes in `parts` ranges of the column `order`, a micro-batch each.

    After each range the stream has ended, and it starts again from its checkpoint: what it needs of earlier ranges is in
    its state. Jobs are run when this is called; what it wrote is removed, unless a folder is given.
    """
    spark = rows.sparkSession
    given, folder = folder, folder or f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    inner = rows.approxQuantile(order, [i / parts for i in range(1, parts)], 0.001) if parts > 1 else []
    cuts = [float("-inf"), *sorted(set(inner)), float("inf")]
    own = rocksdb(spark.newSession())
    for low, high in zip(cuts, cuts[1:], strict=False):
        rows.where((F.col(order) > low) & (F.col(order) <= high)).write.mode("append").parquet(f"{folder}/in")
        stream = own.readStream.schema(rows.schema).parquet(f"{folder}/in")
        run = build(stream).writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{folder}/out")
        run.awaitTermination()
    out = settled(spark.read.parquet(f"{folder}/out"))
    if not given:
        remove(spark, folder)
    return out
