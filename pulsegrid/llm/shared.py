"""What several operators of this subpackage need: tables, folds, words, checkpoints."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import settled, shared_folder, table  # noqa: F401  what operators take from here

#: Records in one Arrow batch: whole texts may be very long, so batches hold few of them.
ARROW_RECORDS = 1000


def small_batches(spark: SparkSession, records: int = ARROW_RECORDS) -> None:
    """Bound the Arrow batches of this session, as a batch of whole texts must fit a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > records:
        spark.conf.set(key, str(records))


def free(df: DataFrame, *names: str) -> list[str]:
    """Each name, or with underscores before it where `df` has a column of that name (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark knows."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage, upon which Spark removes shuffle files and checkpoints that nothing refers to any more.

    Jobs of many small steps leave them behind faster than the driver's memory fills.
    """
    gc.collect()
    spark._jvm.System.gc()


def fold(column: str, mod: int) -> Column:
    """crc32 of the id as text, modulo `mod`; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % mod


def is_fold(column: str, mod: int, value: int) -> Column:
    """Whether the id falls in that fold; a null id falls in none."""
    return F.coalesce(fold(column, mod) == value, F.lit(False))


def ascii_lower_words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of a text as UTF-8, with A-Z lower-cased (null: none).

    bytes.lower() touches only A-Z and bytes.split() splits at exactly those six characters.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    """Columns of an Arrow batch as Python lists."""
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def batch_of(**values) -> pa.RecordBatch:
    """An Arrow batch from arrays or lists, in that order."""
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in values.items()})


def pack(values: np.ndarray) -> bytes:
    """An array as compressed bytes, byte planes apart, so that high bytes that are alike vanish."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, kind: str) -> np.ndarray:
    """The array that pack() was given."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """A sorted uint64 array as packed differences."""
    return pack(np.diff(values, prepend=np.uint64(0)).astype("<u8"))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, "<u8"), dtype=np.uint64)


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow under one name, as most operators use it for whole texts."""
    return df.mapInArrow(fn, schema)


Batches = Iterator[pa.RecordBatch]
