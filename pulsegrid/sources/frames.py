"""Frames of the wearable: decoded where their bytes are, put in order by their first sample's number, gaps told.

A frame has 40 bytes of parameters, 10 of the waveform's header and the waveform: the first sample of eight channels as 16-bit numbers, then what each
channel's next sample differs by, a channel after the other, in a signed byte; a mark stands before a byte that is to be taken as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import CHANNELS

#: Fixed: bytes of the parameters and of the header, its places of the first sample's number and of the count, places of heart rate and battery.
PARAMETERS, HEADER, FIRST, COUNT, RATE, BATTERY = 40, 10, 44, 48, 8, 13
#: Fixed: what a waveform begins with, the mark before a byte that is taken as it is, and millivolts of a step.
BEGIN, MARK, MILLIVOLTS = b"\x80\xff", 0x80, 0.002467
#: Samples whose frames are put in order by one task.
SPAN = 1 << 20
SHAPE = "status int, hr int, battery int, first_index long, count int, channels array<array<int>>, error string"


def decoded(content: bytes) -> dict:
    """A frame's parts; `error` names what is wrong with it, and there are no channels then."""
    out = dict.fromkeys(("status", "hr", "battery", "first_index", "count", "channels", "error"))
    if content is None or len(content) < PARAMETERS + HEADER:
        return out | {"error": "too short for its header"}
    two = lambda at, size=2: int.from_bytes(content[at : at + size], "little")
    out |= {"status": content[0], "hr": two(RATE), "battery": content[BATTERY], "first_index": two(FIRST, 4), "count": two(COUNT)}
    wave, n = content[PARAMETERS + HEADER :], len(CHANNELS)
    if not out["count"]:
        return out | ({"channels": [[] for _ in CHANNELS]} if not wave else {"error": "a waveform of no samples"})
    if wave[:2] != BEGIN:
        return out | {"error": "no waveform begins"}
    if len(wave) < 2 + 2 * n:
        return out | {"error": "too short for the first samples"}
    raw = np.frombuffer(wave, dtype=np.uint8, offset=2 + 2 * n)
    # of marks that follow each other, every second one is itself taken as it is
    marked = raw == MARK
    place = np.arange(len(raw))
    run = np.maximum.accumulate(np.where(marked, -1, place)) if len(raw) else place
    mark = marked & ((place - run) % 2 == 1)
    if len(raw) and mark[-1]:
        return out | {"error": "a mark without a byte"}
    steps = raw[~mark].view(np.int8).astype(np.int64)
    if len(steps) != (out["count"] - 1) * n:
        return out | {"error": f"{len(steps)} differences for {out['count']} samples"}
    first = np.frombuffer(wave, dtype="<i2", count=n, offset=2).astype(np.int64)
    return out | {"channels": np.cumsum(np.concatenate([first[None], steps.reshape(-1, n)]), axis=0).T.tolist()}


def encoded(channels: np.ndarray, first_index: int, status: int = 0, hr: int = 0, battery: int = 0) -> bytes:
    """The frame of whole numbers (eight channels x samples); samples that differ by more than a signed byte holds are an error."""
    x = np.asarray(channels, dtype=np.int64).T
    steps = np.diff(x, axis=0).ravel()
    if len(steps) and (steps.min() < -128 or steps.max() > 127):
        raise ValueError("a difference is too large for a byte")
    raw = steps.astype(np.int8).view(np.uint8)
    wave = np.insert(raw, np.nonzero(raw == MARK)[0], MARK).tobytes()
    head = bytearray(PARAMETERS + HEADER)
    head[0], head[BATTERY] = status, battery
    head[RATE : RATE + 2], head[FIRST : FIRST + 4], head[COUNT : COUNT + 2] = hr.to_bytes(2, "little"), first_index.to_bytes(4, "little"), len(x).to_bytes(2, "little")
    return bytes(head) + (BEGIN + x[0].astype("<i2").tobytes() + wave if len(x) else b"")


def frames(rows: DataFrame, content: str = "content") -> DataFrame:
    """rows with their frame's parts instead of its bytes: status, hr, battery, first_index, count, channels (raw numbers), error."""
    kept = [c for c in rows.columns if c != content]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"status": pa.int32(), "hr": pa.int32(), "battery": pa.int32(), "first_index": pa.int64(), "count": pa.int32(), "channels": pa.list_(pa.list_(pa.int32())), "error": pa.string()}
        for batch in batches:
            made = [decoded(x) for x in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *(pa.array([m[k] for m in made], kind) for k, kind in kinds.items())], [*kept, *kinds])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept)
    return rows.select(*kept, content).mapInArrow(run, f"{schema}, {SHAPE}" if kept else SHAPE)


def in_order(frames_: DataFrame, device: str = "device_id") -> DataFrame:
    """Frames without an error, with `missing` (samples that no frame before has, up to this one's first), `known` (its first samples that one has), and channels without those.

    A device's frames are put in order SPAN samples at a time, so a device that has most of the rows is not one task's; what
    ends before a span is joined to it.
    """
    good = frames_.where("error is null and count > 0").withColumn("_span", F.floor(F.col("first_index") / SPAN)).withColumn("_end", F.col("first_index") + F.col("count"))
    ends = good.groupBy(device, "_span").agg(F.max("_end").alias("_last"))
    before = ends.select(device, "_span", F.max("_last").over(Window.partitionBy(device).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    own = F.max("_end").over(Window.partitionBy(device, "_span").orderBy("first_index", "_end").rowsBetween(Window.unboundedPreceding, -1))
    seen = F.greatest(own, "_before")
    rows = good.join(before, [device, "_span"]).withColumn("_seen", F.coalesce(seen, "first_index"))
    known = F.least(F.greatest(F.col("_seen") - F.col("first_index"), F.lit(0)), F.col("count")).cast("int")
    rows = rows.withColumns({"missing": F.greatest(F.col("first_index") - F.col("_seen"), F.lit(0)), "known": known})
    cut = F.transform("channels", lambda x: F.slice(x, F.col("known") + 1, F.greatest(F.col("count") - F.col("known"), F.lit(0))))
    return rows.withColumn("channels", cut).drop("_span", "_end", "_before", "_seen")


def millivolts(channels: Column) -> Column:
    """Raw numbers as voltages."""
    return F.transform(channels, lambda x: F.transform(x, lambda v: v * F.lit(MILLIVOLTS)))
