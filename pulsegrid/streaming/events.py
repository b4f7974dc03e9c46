"""Events of the gate: what a stream of decisions tells its listeners, and the windows that woke it."""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: events that a listener may fall behind by.
MAX_WAITING = 200
#: Fixed: seconds between pings.
PING = 15.0


def gate_events(decisions: DataFrame, files: DataFrame) -> DataFrame:
    """device_id, t, place, type: a status for each decision; after a wake `wake`, then `ecg_ready` or, without the device's file, `gate_error`."""
    known = files.select("device_id").distinct().withColumn("_file", F.lit(True))
    after = F.when(F.col("_file"), "ecg_ready").otherwise("gate_error")
    kinds = F.when(F.col("wake"), F.array(F.lit("status"), F.lit("wake"), after)).otherwise(F.array(F.lit("status")))
    return decisions.join(known, "device_id", "left").select("device_id", "t", F.posexplode(kinds).alias("place", "type"))


def wake_windows(decisions: DataFrame, windows: DataFrame, length: int) -> DataFrame:
    """device_id, name, samples: the raw windows (device_id, t, samples) that woke the gate, cut or zero-padded to `length`, named by rounded t."""
    woke = decisions.where("wake").select("device_id", "t")
    full = F.slice(F.concat("samples", F.array_repeat(F.lit(0.0), length)), 1, length)
    return windows.join(woke, ["device_id", "t"]).select("device_id", F.format_string("wake_%d", F.round("t").cast("long")).alias("name"), full.alias("samples"))


def dump_wakes(folder: str):
    """For foreachBatch of wake_windows(): each batch in a folder of its own number, so that one that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


def live_chunk(samples: Column, hop: int, fs: int, shown: int = 125) -> Column:
    """The newest `hop` samples at about `shown` a second."""
    newest = F.slice(samples, F.greatest(F.lit(1), F.size(samples) - hop + 1), hop)
    return F.filter(newest, lambda _, i: i % max(1, fs // shown) == 0)


def event_windows(scores: DataFrame, length: str = "10 seconds", hop: str = "2500 milliseconds", late: str | None = None) -> DataFrame:
    """device_id, start, n, score: means over sliding windows of the event time `ts`; rows later than `late` are dropped."""
    rows = scores.withWatermark("ts", late) if late else scores
    return rows.groupBy("device_id", F.window("ts", length, hop).alias("w")).agg(F.count("*").alias("n"), F.avg("score").alias("score")).select("device_id", F.col("w.start").alias("start"), "n", "score")


class Hub:
    """Listeners with bounded queues: a new one gets the last state; one that is full misses what is new."""

    def __init__(self, most: int = MAX_WAITING):
        self.most, self.listeners, self.state = most, [], None

    def subscribe(self) -> queue.Queue:
        listener: queue.Queue = queue.Queue(self.most)
        if self.state is not None:
            listener.put_nowait(self.state)
        self.listeners.append(listener)
        return listener

    def publish(self, event: dict) -> None:
        self.state = event
        for listener in self.listeners:
            if not listener.full():
                listener.put_nowait(event)

    def ping(self) -> None:
        """Tell listeners that are waiting that the hub is alive; it is no state, and a full listener needs none."""
        for listener in self.listeners:
            if listener.empty():
                listener.put_nowait({"type": "ping"})

    def pinging(self, every: float = PING) -> Callable[[], None]:
        """Ping every so many seconds, on a thread of its own, until the function that this returns is called."""
        done = threading.Event()

        def run() -> None:
            while not done.wait(every):
                self.ping()

        thread = threading.Thread(target=run, daemon=True)
        thread.start()

        def stop() -> None:
            done.set()
            thread.join()

        return stop

    def sink(self, batch: DataFrame, _: int) -> None:
        """For foreachBatch: events in the order of time, device and place."""
        for row in batch.orderBy("t", "device_id", "place").toLocalIterator():
            self.publish(row.asDict())
